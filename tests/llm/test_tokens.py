"""Token counts and packing against whole-text encoding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chunks, packing, token_counts

ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a   b\n c", "\n\n x\n", "don't we'll 'S x's", "<|endoftext|>", "a\n <|endoftext|> b <|ENDOFTEXT|>", "é è Éa à", "é x", "İstanbul ΟΔΟΣ", "a b  c", "a\x1cb c", "漢字 かな 12³ x²", "tab\t\tx  \t y", "😀 😀😀", "A_b__c $$_$$ 12ab3", "x" * 5000, "the " * 3000, "a \nb", "a\t b", " \n", "x   y"]
SCHEMA = "doc_id long, text string, n_tokens int, id string"


def frame(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i, t, i, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def random_texts(n=300):
    r = random.Random(5)
    marks = ["a", "B", "the", "Word", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "23", "é", "ß", "_", "$$", " ", "́", "Σ", "😀", "İ"]
    return ["".join(r.choice(marks) + r.choice(["", " "]) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name,split", [("byte_bpe_50k.json", chunks.spaced_chunks), ("word_bpe_49k.json", chunks.worded_chunks)])
def test_chunks_encode_as_the_whole(name, split):
    tokenizer = chunks.load(public_tokenizers.path(name))
    ids = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    for text in [x or "" for x in ODD] + random_texts(3000):
        parts = split(text)
        if parts is not None:
            assert [i for x in parts for i in ids(x)] == ids(text), repr(text)


def test_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = chunks.load(path)
    texts = ODD + ["again"] * 3 + random_texts(50)
    got = token_counts.count_tokens(frame(spark, texts), path, limit=1000).collect()
    want = sorted(((-1 if i == 3 else i), len((t or "").encode()), (n := len(tokenizer.encode(t or "", add_special_tokens=False).ids)), n > 1000) for i, t in enumerate(texts))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(frame(spark, ODD).limit(0), path).collect() == []


def test_cache_restarts():
    t = chunks.Table(len, {"a": 9}, most=3)
    assert [t[x] for x in ("a", "b", "cc", "ddd", "eeee", "a", "b")] == [9, 1, 2, 3, 4, 9, 1] and len(t) <= 4


def test_token_bytes_are_those_of_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = chunks.load(path)
    texts = [x or "" for x in ODD] + random_texts(800) + ["a\x01b \x01 c. \x01,", "word., word.. .,. é., x.a", "\x01"] * 2
    for most in (600_000, 5):
        ids_of = packing.TokenBytes(path, 1, most)
        got = [x for at in range(0, len(texts), 50) for x in ids_of(texts[at : at + 50])]
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def check_layout(rows, limits=packing.LIMITS):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= limits[0] and len(pieces) <= limits[1]
        padding += 0 if at & (at - 1) == 0 else limits[0] - at
    return padding


def test_packing_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = chunks.load(path)
    texts = ODD + random_texts(200) + ["The same words. " * 400] * 5
    rows = packing.pack_documents(frame(spark, texts), path, keep_tokens=True).collect()
    assert check_layout(rows) == 0
    got = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        got[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for i, t in enumerate(texts):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(got[None if i == 3 else i])
        assert [x for _, ids, _ in own for x in ids] == want and {n for *_, n in own} == {len(want)}
    assert packing.pack_documents(frame(spark, ODD).limit(0), path).collect() == []


def test_limits_hold_together():
    r = random.Random(1)
    tokens = [r.randint(0, 300) for _ in range(400)] + [5000]
    loss = [r.randint(0, x) for x in tokens]
    limits = (512, 6, 200)
    for cut in (True, False):
        n = tokens if cut else tokens[:-1]
        m = loss if cut else [min(x, 200) for x in loss[:-1]]
        pieces = packing.pack(n, m, limits, cut)
        used = defaultdict(lambda: [0, 0, 0])
        for p in pieces:
            prompt = n[p.example] - m[p.example]
            borne = max(0, p.start + p.length - prompt) - max(0, p.start - prompt)
            assert p.offset == used[p.sequence][0]
            for k, v in enumerate((p.length, 1, borne)):
                used[p.sequence][k] += v
        assert all(a <= b for u in used.values() for a, b in zip(u, limits, strict=True))
        whole = defaultdict(int)
        for p in pieces:
            assert whole[p.example] == p.start
            whole[p.example] += p.length
        assert dict(whole) == {i: x for i, x in enumerate(n) if x}
    with pytest.raises(ValueError):
        packing.pack([600], [0], limits, cut=False)


def test_counts_without_exchange_or_large_tables(spark):
    """No pre-token is shuffled, and long chunks are neither broadcast nor kept."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, "".join(chr(0x4E00 + (i * 7 + k) % 3000) for k in range(3000)) + " the the") for i in range(20)], "doc_id long, text string")
    frequent = token_counts.frequent_lengths(docs, path)
    assert list(frequent) == [" the"]
    out = token_counts.count_tokens(docs, path, frequent=frequent)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    tokenizer = chunks.load(path)
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    ids_of = packing.TokenBytes(public_tokenizers.path("word_bpe_49k.json"), 1)
    ids_of(["short " + "x" * 500])
    assert max(map(len, ids_of.known), default=0) <= chunks.LONGEST


def test_tiny_documents_are_not_padded(spark):
    docs = spark.range(0, 1500, 1, 2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(rows) >= 1500 and check_layout(rows) == 0


def test_instructions_bear_no_loss(spark):
    """The limit on loss-bearing tokens decides, and prompts don't count for it."""
    path, limits = public_tokenizers.path("word_bpe_49k.json"), (256, 32, 40)
    r = random.Random(3)
    told = [(i, " ".join(["ask"] * r.randint(0, 90)) or None, " ".join(["tell"] * r.randint(0, 60))) for i in range(120)]
    docs = spark.createDataFrame(told, "doc_id long, prompt string, text string").coalesce(2)
    rows = packing.pack_documents(docs, path, limits=limits, prompt_col="prompt", keep_tokens=True).collect()
    tokenizer = chunks.load(path)
    ids = lambda x: tokenizer.encode(x or "", add_special_tokens=False).ids
    whole = {i: (ids(p), [*ids(t), 1]) for i, p, t in told}
    loss, placed = defaultdict(int), defaultdict(list)
    for x in rows:
        prompt, answer = whole[x.doc_id]
        assert x.doc_tokens == len(prompt) + len(answer)
        loss[x.sequence_id] += max(0, x.start + x.length - max(x.start, len(prompt)))
        placed[x.doc_id].append((x.start, x.ids))
    assert {i: [t for _, own in sorted(v) for t in own] for i, v in placed.items()} == {i: p + a for i, (p, a) in whole.items()}
    assert max(loss.values()) == limits[2] and check_layout(rows, limits) == 0
