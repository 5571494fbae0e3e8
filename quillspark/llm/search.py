"""Exact BM25 top-k: an inverted index in shards, block-max WAND pruning in each, and a merge with global statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import as_bytes, stored

K1, B = 1.2, 0.75
#: Documents of a shard (their numbers fit 16 bits), and bytes of their texts, at most (one longer text is a shard of its own).
SHARD_DOCS, SHARD_BYTES = 8192, 24 << 20
#: Documents of a pruning block.
BLOCK = 64
#: Lists with a document in LONG_SHARE or more, LONG_LISTS of a shard at most, are kept as columns with block maxima.
LONG_SHARE, LONG_LISTS = 16, 2048
#: Queries that walk a shard together.
TOGETHER = 256
#: Terms of queries that are broadcast in one round at most; only a query that has more by itself goes beyond.
ROUND_TERMS = 2_000_000
#: Turns at most into which the shards are dealt, and the share of them after which the thresholds are raised again.
TURNS, EARLY = 1024, 8
#: Documents that are scored exactly before the threshold is looked at again.
STEP = 64
#: Bounds are raised by this factor, as sums of 32-bit floats differ in their last bits.
SLACK = 1 + 1e-3

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_codec = pa.Codec("zstd", compression_level=1)


def terms_of(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct words (letters, digits and all above ASCII; A-Z lower-cased) and their counts."""
    words = (text or b"").translate(_WORDS).split()
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), return_counts=True)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the runs that begin at ``starts``, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _shard(ids: list[int], rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[bytes, np.ndarray, np.ndarray, int]:
    """Posting lists by term as packed arrays; vocabulary, document frequencies, words.

    Documents are numbered by their most frequent word, then by length, so that
    those of a block resemble each other and its maxima bound them closely.
    """
    main = np.array([t[np.argmax(c)] if len(t) else 0 for t, c in rows], np.uint64)
    lengths = np.array([int(c.sum()) for _, c in rows], np.int64)
    order = np.lexsort((lengths, main))
    sizes = np.array([len(rows[i][0]) for i in order], np.int64)
    terms = np.concatenate([rows[i][0] for i in order])
    counts = np.concatenate([rows[i][1] for i in order]).astype(np.int32)
    by_term = np.argsort(terms, kind="stable")
    terms = terms[by_term]
    starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
    vocabulary = terms[starts]
    edges = np.append(starts, len(terms)).astype(np.int64)
    docs = np.repeat(np.arange(len(rows)), sizes)[by_term].astype(np.uint16)
    arrays = [np.array(ids, np.int64)[order], vocabulary, edges, docs, counts[by_term]]
    parts = pa.table({"a": pa.array([_codec.compress(x.tobytes(), asbytes=True) for x in arrays], pa.binary()), "n": pa.array([x.nbytes for x in arrays], pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts.schema) as w:
        w.write_table(parts)
    return sink.getvalue().to_pybytes(), vocabulary, np.diff(edges), int(lengths.sum())


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, made = TaskContext.get().partitionId() << 32, 0
    ids, rows, size = [], [], 0

    def full() -> pa.RecordBatch:
        nonlocal made, ids, rows, size
        payload, vocabulary, df, words = _shard(ids, rows)
        arrays = [pa.array([base + made], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([words], pa.int64()), pa.array([payload], pa.binary())]
        arrays += [pa.array([vocabulary.view(np.int64)], pa.list_(pa.int64())), pa.array([df], pa.list_(pa.int64()))]
        made, ids, rows, size = made + 1, [], [], 0
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "n", "length", "payload", "terms", "df"])

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            if i is None:
                continue
            if ids and (len(ids) >= SHARD_DOCS or size + len(t or b"") > SHARD_BYTES):
                yield full()
            ids.append(i), rows.append(terms_of(t))
            size += len(t or b"")
    if ids:
        yield full()


class Shard:
    """Posting lists of a shard with the impact of each posting, the long lists as columns with block maxima, and all postings by document."""

    def __init__(self, payload: bytes, average: float):
        parts = pa.ipc.open_stream(payload).read_all()
        raw = [_codec.decompress(a, decompressed_size=n, asbytes=True) for a, n in zip(parts["a"].to_pylist(), parts["n"].to_pylist(), strict=True)]
        self.ids, self.vocabulary, self.edges, self.doc, counts = (np.frombuffer(x, k) for x, k in zip(raw, (np.int64, np.uint64, np.int64, np.uint16, np.int32), strict=True))
        n, sizes = len(self.ids), np.diff(self.edges)
        norm = K1 * (1 - B + B * np.bincount(self.doc, counts, n) / average)
        self.impact = counts * (K1 + 1) / (counts + norm[self.doc])
        long = np.flatnonzero(sizes >= max(2, n / LONG_SHARE))
        if len(long) > LONG_LISTS:
            long = np.sort(long[np.argsort(-sizes[long], kind="stable")[:LONG_LISTS]])
        self.column = np.full(len(sizes), -1, np.int32)
        self.column[long] = np.arange(len(long))
        at = _spread(self.edges[long], sizes[long])
        self.columns = np.zeros((n, len(long)), np.float32)
        self.columns[self.doc[at], np.repeat(np.arange(len(long)), sizes[long])] = self.impact[at]
        self.starts = np.arange(0, n, BLOCK)
        self.most = np.maximum.reduceat(self.columns, self.starts, axis=0).T.copy()
        by_doc = np.argsort(self.doc, kind="stable")
        self.doc_terms = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by_doc]
        self.doc_impact = self.impact[by_doc]
        self.doc_edges = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=n))])
        self.weight = np.zeros(len(sizes))

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The list of each of the sorted terms, or -1."""
        if not len(self.vocabulary):
            return np.full(len(terms), -1, np.int64)
        at = np.searchsorted(self.vocabulary, terms)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == terms, at, -1)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores by the weights set, summed over each document's terms in the order of their hashes."""
        starts, ends = self.doc_edges[docs], self.doc_edges[docs + 1]
        at = _spread(starts, ends - starts)
        return np.add.reduceat(self.doc_impact[at] * self.weight[self.doc_terms[at]], np.cumsum(ends - starts) - (ends - starts))

    def top(self, asked: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> tuple[list[list[tuple[float, int]]], int, int]:
        """For each (lists, weights, least) the k best (score, id) of ``least`` or more, ties by the smaller id; the blocks ruled out; the documents scored exactly.

        The pivot stands between the long lists and the others. The others are
        walked. What a block's best document has from them, with the block's
        maxima of the long lists, bounds all its documents; blocks whose bound
        stays below ``least`` are skipped, in the others the long lists are
        added. Documents are then scored exactly, by falling sum, until the
        sums fall below the k-th score.
        """
        n, m = len(self.ids), len(asked)
        weights, sums = np.zeros((m, self.columns.shape[1]), np.float32), np.zeros((m, n), np.float32)
        least = np.array([x for *_, x in asked])
        for j, (at, w, _) in enumerate(asked):
            column = self.column[at]
            long = column >= 0
            weights[j, column[long]] = w[long]
            lists = at[~long]
            sizes = self.edges[lists + 1] - self.edges[lists]
            spot = _spread(self.edges[lists], sizes)
            sums[j] = np.bincount(self.doc[spot], self.impact[spot] * np.repeat(w[~long], sizes), n)
        alive = (np.maximum.reduceat(sums, self.starts, axis=1) + weights @ self.most) * SLACK >= least[:, None]
        for b, lo in enumerate(self.starts.tolist()):
            own = np.flatnonzero(alive[:, b])
            if len(own) == m:
                sums[:, lo : lo + BLOCK] += weights @ self.columns[lo : lo + BLOCK].T
            elif len(own):
                sums[own, lo : lo + BLOCK] += weights[own] @ self.columns[lo : lo + BLOCK].T
        found, done = [], 0
        for j, (at, w, low) in enumerate(asked):
            row = sums[j]
            fit = row * np.float32(SLACK) >= low if low > 0 else row > 0
            seen = np.flatnonzero(fit & np.repeat(alive[j], BLOCK)[:n])
            if low <= 0 and len(seen) > 4 * STEP:  # the first steps will do; the rest is looked at below if not
                cut = np.partition(row[seen], len(seen) - 2 * STEP)[len(seen) - 2 * STEP]
                first, rest = seen[row[seen] >= cut], seen[row[seen] < cut]
            else:
                first, rest = seen, seen[:0]
            best: list[tuple[float, int]] = []
            self.weight[at] = w
            for part in (first, rest):
                if not len(part) or len(best) >= k and row[part].max() * SLACK < -best[-1][0]:
                    continue
                part = part[np.argsort(-row[part], kind="stable")]
                upper = row[part].astype(np.float64) * SLACK
                for lo in range(0, len(part), STEP):
                    if len(best) >= k and upper[lo] < -best[-1][0]:
                        break
                    docs = part[lo : lo + STEP]
                    done += len(docs)
                    best = sorted(best + [(-s, i) for s, i in zip(self.scores(docs).tolist(), self.ids[docs].tolist(), strict=True) if s >= low and s > 0])[:k]
            self.weight[at] = 0
            found.append([(-s, i) for s, i in best])
        return found, int(alive.size - alive.sum()), done


def _search(queries, average: float, k: int, numbers: dict[int, int] | None, turns: int, first: int, last: int):
    """Search each shard for the queries whose turns with it lie in [first, last): query i begins with the shards of number i and goes round.

    queries: broadcast (sorted terms, ids, thresholds, [(places among the terms, weights)]).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids, least, asked = queries.value
        for batch in batches:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(payload.as_py(), average)
                at = shard.find(terms)
                number = numbers[key] if numbers else xxhash.xxh3_64_intdigest(key.to_bytes(8, "little")) % turns
                own = [i for i in range(len(ids)) if first <= (number - i) % turns < last]
                out = []
                for lo in range(0, len(own), TOGETHER):
                    part, asks = own[lo : lo + TOGETHER], []
                    for i in part:
                        lists, weights = at[asked[i][0]], asked[i][1]
                        asks.append((lists[lists >= 0], weights[lists >= 0], least[i]))
                    out += [(ids[i], d, s) for i, best in zip(part, shard.top(asks, k)[0], strict=True) for s, d in best]
                if out:
                    q, i, s = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "id", "score"])

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [terms_of(t) for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.view(np.int64) for t, _ in made], pa.list_(pa.int64())), pa.array([c for _, c in made], pa.list_(pa.int64()))], names=["query_id", "terms", "counts"])


def _rounds(ready: DataFrame) -> int:
    """How many rounds, dealt by the hash of the query, keep each within ROUND_TERMS (or down to single queries)."""
    total, most = ready.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.coalesce(F.max(F.size("terms")), F.lit(0))).head()
    rounds = max(1, -(-total // ROUND_TERMS))
    while True:
        own = ready.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(rounds))).agg(F.sum(F.size("terms")).alias("n"))
        if total <= ROUND_TERMS or own.agg(F.max("n")).head()[0] <= max(ROUND_TERMS, 2 * most):
            return rounds
        rounds += -(-rounds // 4)


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "doc_id", query_text_col: str = "text") -> DataFrame:
    """query_id, rank, id and score of the k best documents for each query; fewer where fewer share a term with it.

    BM25 with idf ln(1 + (N - df + 0.5) / (df + 0.5)), over the whole texts of
    documents and queries; N, df and the mean length are those of all
    documents, so shards merge exactly. Queries run in rounds whose broadcast
    is bounded by ROUND_TERMS (or two of the longest queries). In each round a
    query first searches one shard, then an eighth of them, then the rest; its
    k-th score so far is the threshold by which it prunes in the next ones.

    Ids are integers; rows with a null id are no document and no query. Null
    and empty texts match nothing. Repeated document rows are ranked each,
    repeated query ids are one query of all their words. Ties go to the
    smaller id. Other columns are ignored; empty tables give no row.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shards = stored(slim.mapInArrow(_index, "shard long, n long, length long, payload binary, terms array<bigint>, df array<bigint>"), "shards")
    n, length = shards.agg(F.sum("n"), F.sum("length")).head()
    average = max(1.0, (length or 0) / max(1, n or 0))
    asked = queries.select(F.col(query_id_col).cast("long").alias("query_id"), F.col(query_text_col).cast("string").alias("text")).filter("query_id is not null")
    each = asked.mapInArrow(_query_terms, "query_id long, terms array<bigint>, counts array<bigint>").select("query_id", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    each = each.groupBy("query_id", F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))
    df = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    weight = F.col("n") * F.log(1 + (F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # whether a term is in many queries or few, its row is one of a query and a term
    full = each.join(df, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", weight.alias("w")))).alias("v"))
    ready = stored(full.select("query_id", F.col("v.term").alias("terms"), F.col("v.w").alias("w")), "queries")
    rounds = _rounds(ready)
    count = shards.count()
    turns = max(1, min(count, TURNS))
    numbers = {r.shard: i for i, r in enumerate(shards.select("shard").orderBy("shard").collect())} if count <= TURNS else None
    edges = sorted({0, 1, -(-turns // EARLY), turns})
    slim_shards, found = shards.select("shard", "payload"), None
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    for r in range(rounds):
        rows = ready.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r).toArrow()
        lists = [x.values.to_numpy().view(np.uint64) for x in rows["terms"]]
        terms, place = np.unique(np.concatenate(lists) if lists else np.zeros(0, np.uint64), return_inverse=True)
        places = np.split(place.astype(np.int32), np.cumsum([len(x) for x in lists])[:-1]) if lists else []
        weights = [x.values.to_numpy(zero_copy_only=False) for x in rows["w"]]
        ids, asks = rows["query_id"].to_pylist(), list(zip(places, weights, strict=True))
        own = None
        for first, last in zip(edges, edges[1:], strict=False):
            start = {} if own is None else {x.query_id: x.least for x in ranked(own).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).collect()}
            sent = spark.sparkContext.broadcast((terms, ids, [start.get(q, 0.0) for q in ids], asks))
            part = stored(slim_shards.mapInArrow(_search(sent, average, k, numbers, turns, first, last), "query_id long, id long, score double"), "found")
            sent.unpersist()
            own = part if own is None else own.unionAll(part)
        found = own if found is None else found.unionAll(own)
    return ranked(found).select("query_id", "rank", F.col("id").alias(id_col), "score")
