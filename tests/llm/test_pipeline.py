"""Each stage of the pipeline on its own input, against brute force."""

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries, toxicity
from quillspark.llm.common import stored
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_near_dup import brute as groups
from tests.llm.test_secrets import base, weak

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(stored(f(spark, out[-1], SF), name))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "decontaminate", "secrets", "pack"]
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[:-1])


def test_toxicity(spark, steps):
    insults = re.compile(r"\b(trash|idiot|pathetic|worthless|scum|stupid|loser|moron|disgusting|clown)\b", re.I)
    kept = {i for i, _ in texts(steps[1])}
    marked = [i for i, t in texts(steps[0]) if len(insults.findall(t or "")) >= 4]
    assert len(marked) > 5 and sum(i in kept for i in marked) <= 0.1 * len(marked)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in kept for i in clean) > 0.97 * len(clean)


def test_near_dup(steps):
    want = groups(texts(steps[1]), 5, 80)
    assert ids(steps[2]) == sorted(i for i, (_, c) in want.items() if i == c)
    assert len(ids(steps[2])) < len(ids(steps[1]))


def test_decontaminate(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(i for i, _, _, x in windows(texts(steps[2]), items) if not x)
    assert ids(steps[3]) == want and len(want) < len(ids(steps[2]))


def test_secrets(steps):
    want = {}
    for i, t in texts(steps[3]):
        out, at = "", 0
        for s, _, e in sorted(base(t) + weak(t)):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        want[i] = out + t[at:]
    assert dict(texts(steps[4])) == want and any("[SECRET]" in t for t in want.values())
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())


def test_pack(steps):
    whole = defaultdict(int)
    for r in steps[5].collect():
        whole[r.doc_id] += r.length
    assert sorted(whole) == ids(steps[4])


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 3), (1, "a b c d e f", "en", "s", 3), (None, None, None, None, None), (None, "password=abcdefghij", "xx", "s", 1), (2, "", "en", "s", 0), (3, "x " * 60_000, "de", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        docs = stored(f(spark, docs, SF), "odd")
    assert sorted({str(r.doc_id) for r in docs.collect()}) == ["1", "2", "3", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        empty = stored(f(spark, empty, SF), "none")
    assert empty.collect() == []


def test_clashing_names(spark):
    """Helper columns give way to the input's own columns, whatever these are called."""
    extra = ["_id", "_h", "_l", "_spans", "_n", "_gone", "_Rank", "__id", "component_id", "kept"]
    rows = [(1, "a b c d e f g", "en", "s", 3), (2, "a b c d e f g", "en", "s", 3), (2, "token=abcdefghijkl", "en", "s", 5), (3, None, None, None, None)]
    docs = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = stored(f(spark, docs, SF), "clash")
    assert docs.columns[5:] == extra and all(r["_spans"] == "x" for r in docs.collect())
    assert sorted((r.doc_id, r.text) for r in docs.collect() if r.text) == [(1, "a b c d e f g")] and {r.doc_id for r in docs.collect()} == {1, 3}


def test_run_is_all_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    key = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()))
    assert got.columns == steps[-1].columns and set(columns) <= set(got.columns)
    assert key(got) == key(steps[-1])


def test_registered():
    assert queries.queries()["pipeline"] is corpus_pipeline.run and toxicity.CUT == 0.7
