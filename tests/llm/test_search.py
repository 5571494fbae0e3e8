"""BM25 top-k against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import search

SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, queries, k):
    counts = [(i, Counter(words(t))) for i, t in docs if i is not None]
    n, df = len(counts), Counter(w for _, c in counts for w in c)
    mean = max(1.0, sum(sum(c.values()) for _, c in counts) / max(1, n))
    out = {}
    for q, t in queries:
        ask, found = Counter(words(t)), []
        for i, c in counts:
            size = sum(c.values())
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w, m in ask.items() if w in c)
            if s > 0:
                found.append((s, i))
        out[q] = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
    return out


def compare(rows, want):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.doc_id))
    assert set(got) == {q for q, x in want.items() if x}
    for q, have in got.items():
        assert [s for s, _ in have] == pytest.approx([s for s, _ in want[q]], rel=1e-9)
        # ids may change places only where scores are equal up to rounding
        for (s, i), (_, j) in zip(have, want[q], strict=True):
            assert i == j or sum(abs(s - s2) <= 1e-9 * s for s2, _ in want[q]) > 1 or abs(s - want[q][-1][0]) <= 1e-9 * s


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(search, "ROUND_TERMS", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = search.top_k(docs.repartition(3), docs.filter(F.col("doc_id") % 50 == 0)).collect()
    compare(found, brute(rows, [x for x in rows if x[0] % 50 == 0], 10))


def test_edges(spark):
    rows = [(1, "a b c"), (2, ""), (3, None), (None, "a"), (4, "A a a b " * 9000), (5, "x y"), (5, "x y"), (6, "é É a-b")]
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, rank int")
    compare(search.top_k(docs, docs.filter("doc_id <> 5"), k=3).collect(), brute(rows, [x for x in rows if x[0] not in (None, 5)], 3))
    assert search.top_k(docs.limit(0), docs).collect() == [] and search.top_k(docs, docs.limit(0)).collect() == []


def test_pruning_skips_blocks():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    texts = [b" ".join(b"w%d" % x for x in rng.zipf(1.3, 40)) for _ in range(4000)]
    texts[1234] = b"rare words here only"

    class Fake:
        @staticmethod
        def get():
            return Fake()

        def partitionId(self):
            return 0

    search.TaskContext, old = Fake, search.TaskContext
    try:
        made = list(search._index(iter([pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([t.decode() for t in texts])], names=["id", "text"])])))
    finally:
        search.TaskContext = old
    shard = search.Shard(made[0].column(3)[0].as_py(), 40.0)
    terms, counts = search.terms_of(b"rare words here only w1")
    weights = np.where(np.isin(terms, search.terms_of(b"w1")[0]), 0.1, 5.0)
    whole, none, _ = shard.top([(shard.find(terms), weights, 0.0)], 1)
    assert whole[0][0][1] == 1234 and none == 0
    again, ruled_out, scored = shard.top([(shard.find(terms), weights, whole[0][0][0])], 1)
    assert again == whole and ruled_out == len(shard.starts) - 1 and scored == 1


def test_many_shards_in_turns(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 9)
    monkeypatch.setattr(search, "ROUND_TERMS", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for turns in (1024, 5):
        monkeypatch.setattr(search, "TURNS", turns)
        compare(search.top_k(docs, docs.filter("doc_id % 50 = 0"), k=4).collect(), brute(rows, [x for x in rows if x[0] % 50 == 0], 4))
