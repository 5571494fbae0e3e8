"""Quality and toxicity: held-out accuracy and the edges of the input."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"
EDGES = [(1, "a"), (2, ""), (3, None), (None, "b c"), (4, "x " * 60_000), (4, "x " * 60_000)]


def accuracy(spark, name, label):
    rows = getattr(queries, name)(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    return np.mean([r.predicted == r[label] for r in rows])


def test_quality_held_out(spark):
    assert accuracy(spark, "op1_quality", "quality") > 0.95


def test_toxicity_held_out(spark):
    assert accuracy(spark, "op5_toxicity", "toxic") > 0.9


def test_held_out_is_crc_of_the_id(spark):
    rows = queries.op1_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def edge_frames(spark):
    docs = spark.createDataFrame([(i, t, None if t == "" else "en", 5, 0.5) for i, t in EDGES], "doc_id long, text string, lang string, score int, id double")
    return docs, docs.limit(0)


def test_edges(spark):
    docs, none = edge_frames(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        ranker, model = quality.fit(docs, known), toxicity.fit(docs, known)
        for run, fitted in ((quality.score, ranker), (toxicity.score, model)):
            rows = run(docs, fitted).collect()
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in EDGES) and all(0 <= r.score <= 1 for r in rows)
            assert run(none, fitted).collect() == []


def test_bradley_terry_orders_by_preference():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, quality.FEATURES))
    truth = x[:, 5] - 2 * x[:, 7]
    a, b = rng.integers(0, 300, 4000), rng.integers(0, 300, 4000)
    better, worse = np.where(truth[a] > truth[b], a, b), np.where(truth[a] > truth[b], b, a)
    u = quality.learn_pairs(x, better, worse).utilities(x)
    assert np.corrcoef(u, truth)[0, 1] > 0.9


def test_convolution_sees_phrases_and_positions():
    """A phrase decides, not its words: only a filter of width two can tell."""
    r = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    texts, labels = [], []
    for k in range(600):
        t = [r.choice(words) for _ in range(r.randint(5, 150))]
        at = r.randrange(len(t))
        t[at:at] = ["red", "flag"] if k % 2 else ["flag", "red"]
        texts.append(toxicity.word_buckets(" ".join(t).encode()))
        labels.append(k % 2)
    model = toxicity.train(texts[:400], np.array(labels[:400]), ["en"] * 400, epochs=12)
    got = model.scores(texts[400:]) >= toxicity.CUT
    assert np.mean(got == np.array(labels[400:])) > 0.9


def test_batches_do_not_change_scores():
    texts = [toxicity.word_buckets(t) for t in (b"", b"one two", b"idiot " * 200, b"a b c d" * 40)]
    model = toxicity.train(texts * 5, np.array([0, 0, 1, 0] * 5), [None] * 20)
    assert np.allclose(model.logits(texts), np.concatenate([model.logits([t]) for t in texts]), atol=1e-5)


def test_toxicity_is_calibrated_over_all_usable_labels(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    rows = []
    for i in range(1200):
        toxic = int(i % 20 == 0)
        t = [r.choice(words) for _ in range(30)] + ["idiot"] * (toxic or i % 10 == 1)  # as many false alarms as hits by that word
        rows.append((i, " ".join(t), "en" if i % 3 else "de", toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(3)
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    seen, real = [], toxicity._threshold

    def threshold(z, y, *weight):
        w = weight[0] if weight else np.ones(len(z))
        seen.append((w[y == 0].sum(), w[y == 1].sum()))
        return real(z, y, *weight)

    monkeypatch.setattr(toxicity, "_threshold", threshold)
    toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), F.col("doc_id") % 4 < 3)
    used = [x for x in rows if x[0] % 4 < 3]
    count = lambda lang: tuple(sum(x[3] == y and (not lang or x[2] == lang) for x in used) for y in (0, 1))
    assert seen == [count(None), count("de"), count("en")]


def plain_quality(ranker, text):
    """Features and score of one text, written out."""
    words, n = text.split(), len(text)
    if not words:
        f = [1.0] + [0.0] * (quality.FEATURES - 1)
    else:
        upper, lower = sum(65 <= b <= 90 for b in text), sum(97 <= b <= 122 for b in text)
        high, digits = sum(b >= 128 for b in text), sum(48 <= b <= 57 for b in text)
        marks = [text.count(bytes([m])) for m in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
        lines, sizes = [x for x in text.split(b"\n") if x.strip()], [len(w) for w in words]
        mean = sum(sizes) / len(sizes)
        shares = [upper / max(1, upper + lower + high), digits / n, high / n, sum(marks) / n, *[m / len(words) for m in marks], len(set(words)) / len(words), 1 - len(set(lines)) / len(lines), sizes.count(1) / len(sizes)]
        shapes = [math.log1p(len(words)), math.log1p(len(words) / len(lines)), math.log(mean), math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)) / mean, math.log1p(max(sizes))]
        f = [0.0, *[math.sqrt(x) for x in shares], *shapes]
    z = [(v - m) / s for v, m, s in zip(f, ranker.mean, ranker.std, strict=True)]
    u = sum(w * v for w, v in zip(ranker.weights, [*[3 * math.tanh(x / 3) for x in z], *[math.tanh(abs(x) - 1) for x in z]], strict=True))
    return 1 / (1 + math.exp(-max(-40, min(40, ranker.scale * (u - ranker.threshold) + math.log(0.3 / 0.7))))), u


def test_quality_scores_and_threshold_are_those_written_out(spark):
    """The query's scores on the whole table, and the threshold at the quantile of all usable labels."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ranker = quality.fit(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    want = {r.doc_id: plain_quality(ranker, (r.text or "").encode()) for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op1_quality(spark, SF).collect()}
    assert len(got) == len(want) and all(abs(got[i].score - s) < 1e-6 and got[i].predicted == (got[i].score >= 0.3) for i, (s, _) in want.items())
    used = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.quality is not None]
    above = np.mean([want[r.doc_id][1] >= ranker.threshold for r in used])
    assert abs(above - np.mean([r.quality for r in used])) < 0.01


def plain_toxicity(model, buckets):
    """Score of one text by loops over segments, positions, widths and offsets."""
    rows = [sum((model.emb[model.place[b]] for b in word), np.zeros(toxicity.DIM)) for word in buckets]
    segments = -(-(len(rows) + max(toxicity.WIDTHS) - 1) // toxicity.SEGMENT)
    rows += [np.zeros(toxicity.DIM)] * (segments * toxicity.SEGMENT - len(rows))
    tops, offset = [], 0
    for j, width in enumerate(toxicity.WIDTHS):
        own = model.filters[:, toxicity.FILTERS * offset : toxicity.FILTERS * (offset + width)].reshape(toxicity.DIM, width, toxicity.FILTERS)
        y = [sum((rows[at - k] @ own[:, k] for k in range(width) if at >= k), np.zeros(toxicity.FILTERS)) for at in range(len(rows))]
        bias = model.bias[j * toxicity.FILTERS : (j + 1) * toxicity.FILTERS]
        tops.append([np.maximum(np.max(y[s : s + toxicity.SEGMENT], axis=0) + bias, 0) for s in range(0, len(rows), toxicity.SEGMENT)])
        offset += width
    pooled = np.concatenate([*[np.max(t, axis=0) for t in tops], *[np.mean(t, axis=0) for t in tops]])
    z = pooled @ model.out + model.shift
    return 1 / (1 + math.exp(-max(-40, min(40, model.scale * (z - model.centre) + math.log(0.7 / 0.3)))))


def test_toxicity_scores_are_those_written_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    texts = {r.doc_id: toxicity.word_buckets((r.text or "").encode()) for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SF).collect()}
    assert len(got) == len(texts)
    for i in sorted(texts, key=lambda i: (len(texts[i]) > 600, i))[:300]:
        assert abs(got[i].score - plain_toxicity(model, texts[i])) < 1e-4
    assert all(r.predicted == (r.score >= 0.7) and r.rejected == (r.score >= r.threshold) for r in got.values())
