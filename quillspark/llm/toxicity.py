"""Toxicity scores by a convolutional text classifier over hashed words, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import as_bytes, release_memory, sized

BUCKETS = 1 << 20
#: Labelled documents that training sees at most, of each label; taken by a hash of their id.
SAMPLE = 2_000
#: Buckets with an embedding of their own, at most; all others share a zero embedding.
ACTIVE = 1 << 15
#: A word's vector is the sum over the word and its prefixes of so many bytes.
PREFIXES = (4, 6, 7)
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
#: Words of a pooling segment. A filter's maxima over the segments are pooled again, by their maximum and their mean.
SEGMENT = 64
#: The score at which a text counts as toxic.
CUT = 0.7
#: Toxic labels of one language at which its own threshold counts as much as the common one.
LANGUAGE_HALF = 20
FOLDS = 3
#: Steps of a logit's unit in which documents outside the sample are counted.
STEPS = 256

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_OFFSETS = [(j, k) for j, w in enumerate(WIDTHS) for k in range(w)]


def word_buckets(text: bytes | None) -> np.ndarray:
    """Buckets of each word and its prefixes, one row a word: runs of letters, A-Z lower-cased."""
    words = (text or b"").translate(_LETTERS).split()
    columns = [words, *[[w[:n] for w in words] for n in PREFIXES]]
    found = [np.fromiter(map(xxhash.xxh3_64_intdigest, c), np.uint64, len(words)) for c in columns]
    return (np.stack(found, axis=1) & np.uint64(BUCKETS - 1)).astype(np.int32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _lay(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' rows one after the other, each filled with zero rows to whole segments; and the segment at which each starts."""
    sizes = [-(-(len(r) + max(WIDTHS) - 1) // SEGMENT) for r in rows]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    laid = np.zeros((starts[-1] * SEGMENT, 1 + len(PREFIXES)), dtype=np.int32)
    for s, r in zip(starts, rows, strict=False):
        laid[s * SEGMENT : s * SEGMENT + len(r)] = r
    return laid, starts[:-1]


def _convolve(vectors: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Segments x positions x (width, filter). filters: DIM x (width and offset, filter)."""
    y = vectors @ filters
    parts = []
    for j, w in enumerate(WIDTHS):
        at = [FILTERS * _OFFSETS.index((j, k)) for k in range(w)]
        own = y[:, at[0] : at[0] + FILTERS].copy()
        for k in range(1, w):
            own[k:] += y[:-k, at[k] : at[k] + FILTERS]  # backwards: before a text stand only its own or zero rows
        parts.append(own)
    return np.concatenate(parts, axis=1).reshape(-1, SEGMENT, FILTERS * len(WIDTHS))


@dataclass
class Model:
    place: np.ndarray  # bucket -> row of the embeddings, 0 for none
    emb: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray  # for the maxima, then for the means
    shift: float
    scale: float = 1.0
    centre: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        laid, starts = _lay([self.place[x] for x in texts])
        vectors = self.emb[laid[:, 0]]
        for k in range(1, laid.shape[1]):
            vectors += self.emb[laid[:, k]]
        top = np.maximum(_convolve(vectors, self.filters).max(axis=1) + self.bias, 0)
        return _joined(top, starts) @ self.out + self.shift

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return _sigmoid(self.scale * (self.logits(texts) - self.centre) + np.log(CUT / (1 - CUT)))


def _joined(top: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = np.diff(np.append(starts, len(top)))
    return np.concatenate([np.maximum.reduceat(top, starts, axis=0), np.add.reduceat(top, starts, axis=0) / n[:, None]], axis=1)


def _fitted(texts: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int) -> Model:
    """Embeddings, filters and output by logistic loss, without calibration. The embeddings start from log-odds between the labels."""
    rng = np.random.default_rng(seed)
    df = np.zeros(BUCKETS, dtype=np.int32)
    hits = np.zeros(BUCKETS, dtype=np.int32)
    for x, y in zip(texts, labels, strict=True):
        u = np.unique(x)
        df[u] += 1
        if y:
            hits[u] += 1
    active = np.flatnonzero(df >= 3)
    if len(active) > ACTIVE - 1:
        active = active[np.argsort(-df[active], kind="stable")[: ACTIVE - 1]]
    place = np.zeros(BUCKETS, dtype=np.int32)
    place[active] = np.arange(1, len(active) + 1)
    n, pos = len(labels), labels.sum()
    rate = pos / n
    odds = np.log((hits[active] + 2 * rate) / (df[active] + 2)) - np.log(1 - (hits[active] + 2 * rate) / (df[active] + 2)) - np.log(rate / (1 - rate))
    emb = rng.normal(0, 0.02, (len(active) + 1, DIM))
    emb[0] = 0
    emb[1:, 0] = np.clip(odds, -1, 4) / (1 + len(PREFIXES))
    filters = rng.normal(0, 0.1, (DIM, FILTERS * len(_OFFSETS)))
    for j in range(len(WIDTHS)):
        filters[0, FILTERS * _OFFSETS.index((j, 0))] = 1.0
    wide = FILTERS * len(WIDTHS)
    bias, out, shift = np.zeros(wide), rng.normal(0, 0.05, 2 * wide), -2.0
    out[::FILTERS] = 0.5
    rows = [place[x] for x in texts]
    order = rng.permutation(n)
    weight = np.where(labels > 0, n / (2 * pos), n / (2 * (n - pos)))
    sums = {"emb": np.full_like(emb, 0.1), "filters": np.full_like(filters, 0.1), "bias": np.full_like(bias, 0.1), "out": np.full_like(out, 0.1)}

    def step(name, p, g, pace=0.03):
        sums[name] += g * g
        p -= pace * g / np.sqrt(sums[name])

    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, n, 32):
            batch = order[at : at + 32]
            laid, starts = _lay([rows[i] for i in batch])
            vectors = emb[laid].sum(axis=1)
            y = _convolve(vectors, filters)
            place_of = y.argmax(axis=1)  # segments x filters
            top = np.maximum(np.take_along_axis(y, place_of[:, None], axis=1)[:, 0] + bias, 0)
            h = _joined(top, starts)
            z = h @ out + shift
            err = (_sigmoid(z) - labels[batch]) * weight[batch] / len(batch)
            sizes = np.diff(np.append(starts, len(top)))
            of = np.repeat(np.arange(len(batch)), sizes)
            g_h = np.outer(err, out)
            g = (g_h[:, wide:] / sizes[:, None])[of] + g_h[of, :wide] * (top == h[of, :wide])
            g *= top > 0
            step("out", out, h.T @ err + 1e-3 * out)
            shift -= 0.03 * float(err.sum())
            step("bias", bias, g.sum(axis=0))
            g_filters = np.zeros_like(filters)
            ids, back = [], []
            first = SEGMENT * np.arange(len(top))[:, None] + place_of
            for i, (j, k) in enumerate(_OFFSETS):
                at_j, at_i = slice(FILTERS * j, FILTERS * (j + 1)), slice(FILTERS * i, FILTERS * (i + 1))
                own = g[:, at_j]
                s, f = np.nonzero(own)
                where = np.maximum(first[:, at_j][s, f] - k, 0)
                v = own[s, f]
                for c in range(FILTERS):
                    g_filters[:, at_i.start + c] = vectors[where[f == c]].T @ v[f == c]
                ids.append(laid[where])
                back.append(v[:, None] * filters[:, at_i].T[f])
            ids = np.concatenate(ids)
            touched, inverse = np.unique(ids, return_inverse=True)
            back = np.repeat(np.concatenate(back), ids.shape[1], axis=0)
            g_emb = np.stack([np.bincount(inverse.ravel(), back[:, d], len(touched)) for d in range(DIM)], axis=1)
            g_emb[touched == 0] = 0
            sums["emb"][touched] += g_emb**2
            emb[touched] -= 0.03 * g_emb / np.sqrt(sums["emb"][touched])
            step("filters", filters, g_filters + 1e-3 * filters)
    return Model(place, emb.astype(np.float32), filters.astype(np.float32), bias.astype(np.float32), out.astype(np.float32), float(shift))


def train(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], epochs: int = 5, seed: int = 7) -> Model:
    """Fit on all texts; calibrate the score and the thresholds by language on logits of models that haven't seen the text.

    With one label alone, or none, every score is far on that side (none: not toxic).
    """
    labels = np.asarray(labels, dtype=np.float64)
    model, parts, z = _trained(texts, labels, epochs, seed)
    if parts:
        _calibrate(model, z, labels, langs, np.ones(len(labels)))
    return model


def _trained(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 5, seed: int = 7) -> tuple[Model, list[Model], np.ndarray]:
    """A model of all texts, one of each fold's rest, and each text's logit by the model that hasn't seen it; no folds where a label is too rare."""
    n, pos = len(labels), labels.sum()
    if not min(pos, n - pos) >= FOLDS:
        far = 50.0 if pos <= n - pos else -50.0
        wide = FILTERS * len(WIDTHS)
        return Model(np.zeros(BUCKETS, dtype=np.int32), np.zeros((1, DIM), np.float32), np.zeros((DIM, FILTERS * len(_OFFSETS)), np.float32), np.zeros(wide, np.float32), np.zeros(2 * wide, np.float32), 0.0, 1.0, far), [], np.zeros(n)
    z = np.zeros(n)
    fold = np.zeros(n, dtype=np.int64)
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        fold[own] = np.arange(len(own)) % FOLDS
    parts = []
    for k in range(FOLDS):
        seen, kept = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        parts.append(_fitted([texts[i] for i in seen], labels[seen], epochs, seed + k))
        for at in range(0, len(kept), 256):
            z[kept[at : at + 256]] = parts[k].logits([texts[i] for i in kept[at : at + 256]])
    return _fitted(texts, labels, epochs, seed), parts, z


def _calibrate(model: Model, z: np.ndarray, labels: np.ndarray, langs: list[str | None], weight: np.ndarray) -> None:
    """Set the score's centre and scale and the thresholds by language. weight: how many documents a row stands for."""
    mean = np.average(z, weights=weight)
    model.centre, model.scale = _threshold(z, labels, weight), 2.0 / max(0.2, float(np.sqrt(np.average((z - mean) ** 2, weights=weight))))
    of = np.array([x or "" for x in langs], dtype=object)
    for lang in sorted({x for x in langs if x}):
        own = of == lang
        n_own = (weight * labels)[own].sum()
        if min(n_own, weight[own].sum() - n_own) >= FOLDS:
            t = n_own / (n_own + LANGUAGE_HALF) * (_threshold(z[own], labels[own], weight[own]) - model.centre)
            model.thresholds[lang] = float(_sigmoid(model.scale * t + np.log(CUT / (1 - CUT))))


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the best F1."""
    order = np.argsort(-z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    f1 = 2 * np.cumsum(weight * y) / (np.cumsum(weight) + (weight * y).sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    ends = np.append(z[1:], z[-1] - 1)
    at = best[np.argmax((z - ends)[best])]
    return float((z[at] + ends[at]) / 2)


def fit(docs: DataFrame, labels: DataFrame, usable=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "toxic") -> Model:
    """Train on a bounded sample of labelled documents: SAMPLE of each label at most, by a hash of the id.

    ``usable`` is a condition on the labels table. Rows without id or label are left out, repeated ids count once.
    The score and the thresholds are calibrated over all usable labels: documents outside the sample come as counts
    of their logits, by a model of one fold, which hasn't seen them either.
    """
    known = labels.filter(usable) if usable is not None else labels
    known = known.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    sample = None
    for y in (0, 1):
        part = known.filter(F.col("_y") == y).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(SAMPLE)
        sample = part if sample is None else sample.unionAll(part)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t"), lang.alias("_l"))
    rows = slim.join(F.broadcast(sample), "_id").select("_id", "_y", "_l", "_t").toArrow().sort_by("_id")
    # one text at a time, and the rows go before training begins: the driver holds buckets only
    texts = [word_buckets(t.as_py()) for t in rows["_t"]]
    y, langs = np.array(rows["_y"].to_pylist(), dtype=np.float64), rows["_l"].to_pylist()
    del rows
    release_memory(docs.sparkSession)
    model, parts, z = _trained(texts, y)
    del texts
    if parts:
        rest = sized(known.filter(F.col("_y").isin(0, 1)).join(F.broadcast(sample.select("_id")), "_id", "left_anti"), "rest")
        more = _counted(slim.join(rest, "_id"), parts).toArrow()
        z = np.concatenate([z, (more["at"].to_numpy() + 0.5) / STEPS])
        weight = np.concatenate([np.ones(len(y)), more["c"].to_numpy()])
        _calibrate(model, z, np.concatenate([y, more["_y"].to_numpy()]), langs + more["_l"].to_pylist(), weight)
    release_memory()
    return model


def _counted(docs: DataFrame, parts: list[Model]) -> DataFrame:
    """_l, _y, at, c: documents by language, label and logit in steps of 1 / STEPS. Each takes the model of one fold, by its id."""
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fold, z = part.column(2).to_numpy(), np.zeros(part.num_rows)
                texts = [word_buckets(t) for t in part.column(3).to_pylist()]
                for k in np.unique(fold):
                    own = np.flatnonzero(fold == k)
                    z[own] = sent.value[k].logits([texts[i] for i in own])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.floor(z * STEPS).astype(np.int64))], names=["_l", "_y", "at"])

    slim = docs.select("_l", "_y", F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(len(parts))).alias("fold"), "_t")
    return slim.mapInArrow(run, "_l string, _y int, at long").groupBy("_l", "_y", "at").agg(F.count("*").alias("c"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose text stays below the threshold of its language. A map; edges as in ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            at_text = batch.schema.get_field_index(text_col)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = m.scores([word_buckets(t) for t in as_bytes(part.column(at_text))])
                langs = part.column(batch.schema.get_field_index(lang_col)).to_pylist() if lang_col else [None] * len(s)
                keep = s < np.array([m.thresholds.get(x, CUT) for x in langs])
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row for each input row: id, score, lang, threshold of the row's language, rejected.

    The score depends on the text alone. Null and empty texts are scored as
    texts without words; null ids and repeated rows stay; other columns are
    ignored; an unknown or null language takes the common threshold.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = m.scores([word_buckets(t) for t in as_bytes(part.column(1))])
                langs = part.column(2).to_pylist()
                t = np.array([m.thresholds.get(x, CUT) for x in langs])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.astype(np.float64)), part.column(2), pa.array(t), pa.array(s >= t)], names=["id", "score", "lang", "threshold", "rejected"])

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    return slim.mapInArrow(run, f"id {kind}, score double, lang string, threshold double, rejected boolean").withColumnRenamed("id", id_col)
