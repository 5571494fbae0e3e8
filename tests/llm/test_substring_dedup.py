"""Removal of repeated windows against a dictionary of all windows."""

import hashlib
import random
import re

from quillspark.llm import queries, substring_dedup

SF = "/root/testdata/sf0.01"


def brute(rows, size):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - size + 1):
            if i is not None:
                x = tuple(w[k : k + size])
                least[x] = min(least.get(x, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()], key=str)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows, 13)]
    have = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substring_dedup(spark, SF).collect()]
    assert sorted(have) == sorted(want) and sum(m for _, _, m, _ in want) > 0


def test_many_blocks_and_shards(spark):
    small = {"block_bytes": 3000, "shard_bytes": 4000, "shard_bits": 12}
    r = random.Random(9)
    passages = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(3, 40))) for _ in range(12)]
    texts = [" ".join(r.choice(passages) if r.random() < 0.5 else "".join(r.choice("xyzé") for _ in range(5)) for _ in range(r.randint(0, 25))) for _ in range(300)]
    rows = [(r.randint(0, 250), t) for t in texts] + [(None, texts[0]), (None, texts[1]), (7, None), (8, ""), (9, " \n "), (-5, texts[2]), (2**40, texts[3]), (3, "q " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, id int, kept string").repartition(6)
    for size in (5, 13):
        assert got(substring_dedup.remove_repeats(docs, size, **small)) == brute(rows, size)
    assert substring_dedup.remove_repeats(docs.limit(0), 5).collect() == []


def test_counts_never_too_small():
    """Cells that several blocks share count two or more in every block."""
    import numpy as np
    import pyarrow as pa

    parts = [np.unique(np.random.default_rng(k).integers(0, 500, 60)).astype(np.uint32) for k in range(5)]
    flags = [np.zeros(len(p), bool) for p in parts]
    flags[0][3] = True
    sent = [(0, k, len(p), substring_dedup._rising(p), np.packbits(f).tobytes(), None) for k, (p, f) in enumerate(zip(parts, flags))]
    out = substring_dedup._added(pa.Table.from_batches([substring_dedup._sent(sent)]), 12).to_pylist()
    for row, p, f in zip(out, parts, flags):
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=len(p)).astype(bool)
        assert bits.tolist() == [bool(x) or sum(c in q for q in parts) > 1 for c, x in zip(p, f)]
