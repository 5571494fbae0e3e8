"""Quality scores by Bradley-Terry ranking of document pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import as_bytes, sized

#: Labelled documents that training sees at most, of each label; taken by a hash of their id.
SAMPLE = 3_000
#: Preference pairs in which each document of the sample stands at least once, and so many at most.
PAIRS = 40_000
#: Steps of a utility's unit in which documents are counted for the threshold.
STEPS = 1024
#: The score at which a text counts as good.
CUT = 0.3

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_UPPER, _LOWER, _DIGITS = slice(65, 91), slice(97, 123), slice(48, 58)


def features(text: bytes | None) -> np.ndarray:
    """Shares of kinds of bytes, and shapes of the words and lines, of a whole text; all zero but the first for an empty one."""
    text = text or b""
    n = len(text)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    out = np.zeros(FEATURES)
    out[0] = 1.0 if not words else 0.0
    if not words:
        return out
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    marks = counts[list(_MARKS)]
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum()
    own = set(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    shares = [counts[_UPPER].sum() / max(1, letters), counts[_DIGITS].sum() / n, counts[128:].sum() / n, marks.sum() / n, *(marks / len(words)), len(own) / len(words), 1 - len(set(lines)) / len(lines), np.mean(lengths == 1)]
    out[1 : 1 + len(shares)] = np.sqrt(shares)
    out[1 + len(shares) :] = [np.log1p(len(words)), np.log1p(len(words) / len(lines)), np.log(lengths.mean()), lengths.std() / lengths.mean(), np.log1p(lengths.max())]
    return out


FEATURES = 1 + 4 + len(_MARKS) + 3 + 5


@dataclass
class Ranker:
    """Utility of a text: weights times standardised features. The score is 0.3 at the threshold, which is a quantile of utilities."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    scale: float = 1.0

    def utilities(self, x: np.ndarray) -> np.ndarray:
        # a difference of tanh-bounded features keeps one extreme value from deciding alone
        return _bounded((x - self.mean) / self.std) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.utilities(x) - self.threshold) + np.log(CUT / (1 - CUT)), -40, 40)))


def _bounded(z: np.ndarray) -> np.ndarray:
    return np.concatenate([3 * np.tanh(z / 3), np.tanh(np.abs(z) - 1)], axis=1)


def preference_pairs(labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(better, worse): documents with label 1 are preferred to those with label 0."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    n = min(PAIRS, max(len(good), len(bad)) * 8)
    cover = lambda x: np.concatenate([rng.permutation(x) for _ in range(-(-n // len(x)))])[:n]
    return cover(good), cover(bad)


def learn_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> Ranker:
    """Bradley-Terry: P(a before b) = sigmoid(w (f(a) - f(b))); Newton steps on the logistic loss of the differences."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std < 1e-6] = 1.0
    f = _bounded((x - mean) / std)
    d = f[better] - f[worse]
    w = np.zeros(f.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (p - 1) / len(d) + ridge * w
        h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return Ranker(mean, std, w)


def train(x: np.ndarray, labels: np.ndarray, share_good: float, counted: tuple[np.ndarray, np.ndarray] | Callable | None = None, seed: int = 3) -> Ranker:
    """Learn from pairs between the labels, then set the threshold at the quantile of utilities that leaves ``share_good`` above it.

    counted: rising utilities and how many documents have each, or a function
    of the ranker that finds them; by default those of the sample, each label
    with the share it has among all labelled documents. With one label alone,
    every score is far on that side; without any, above.
    """
    labels = np.asarray(labels)
    if len(labels) == 0 or labels.min() == labels.max():
        far = 50.0 if len(labels) and labels.max() == 0 else -50.0
        return Ranker(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(2 * FEATURES), far)
    ranker = learn_pairs(x, *preference_pairs(labels, np.random.default_rng(seed)))
    if counted is None:
        u = ranker.utilities(x)
        weight = np.where(labels == 1, share_good / (labels == 1).sum(), (1 - share_good) / (labels == 0).sum())
        order = np.argsort(u)
        counted = u[order], weight[order]
    u, weight = counted(ranker) if callable(counted) else counted
    ranker.threshold = _between(u, np.cumsum(weight) / weight.sum(), 1 - share_good)
    ranker.scale = 1.5
    return ranker


def _between(u: np.ndarray, cumulated: np.ndarray, q: float) -> float:
    """The weighted quantile, moved to the middle of the gap around it."""
    at = max(0, min(int(np.searchsorted(cumulated, q)), len(u) - 2))
    return float((u[at] + u[min(at + 1, len(u) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, usable=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """Train on a bounded sample of labelled documents: SAMPLE of each label at most, by a hash of the id.

    ``usable`` is a condition on the labels table. Rows without id or label are
    left out, repeated ids count once. The share of good documents and the
    quantile of utilities that goes with it are taken over all usable labels;
    only features of the sample and counts of utilities come to the driver.
    """
    known = labels.filter(usable) if usable is not None else labels
    known = known.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    known = sized(known, "labels")
    share = known.agg(F.avg("_y")).head()[0]
    sample = None
    for y in (0, 1):
        part = known.filter(F.col("_y") == y).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(SAMPLE)
        sample = part if sample is None else sample.unionAll(part)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    rows = _featured(slim.join(F.broadcast(sample), "_id")).toArrow().sort_by("id")
    x = np.array(rows["f"].to_pylist(), dtype=np.float64).reshape(rows.num_rows, FEATURES)

    def counted(ranker: Ranker) -> tuple[np.ndarray, np.ndarray]:
        all_known = score(slim.join(known.filter(F.col("_y").isin(0, 1)), "_id"), ranker, "_id", "_t")
        found = all_known.groupBy(F.floor(F.col("utility") * STEPS).alias("at")).agg(F.count("*").alias("c")).toArrow().sort_by("at")
        return (found["at"].to_numpy() + 0.5) / STEPS, found["c"].to_numpy().astype(np.float64)

    return train(x, np.array(rows["y"].to_pylist(), dtype=np.int64), float(share if share is not None else 1.0), counted)


def _featured(docs: DataFrame) -> DataFrame:
    """id, y and the features of each document."""
    kind = dict(docs.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([features(t) for t in as_bytes(batch.column(2))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["id", "y", "f"])

    return docs.select("_id", "_y", "_t").mapInArrow(run, f"id {kind}, y int, f array<double>")


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, score, utility.

    Null and empty texts are scored as texts without words; null ids and
    repeated rows stay; other columns are ignored; an empty table gives no row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranker)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([features(t) for t in as_bytes(batch.column(1))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(x)), pa.array(sent.value.utilities(x))], names=["id", "score", "utility"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, score double, utility double").withColumnRenamed("id", id_col)
