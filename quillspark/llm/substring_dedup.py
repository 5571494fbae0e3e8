"""Removal of word windows that already stand in an earlier document.

Three passes over blocks of documents. The first makes count-min sketches of
the windows of each block; they are merged shard by shard, and every block
learns which of its cells count two or more. The second sends only windows all
of whose cells do, with the block's smallest id for each, and learns for which
an earlier document exists elsewhere. The third removes words. As a sketch
never counts too little, no repeated window is lost.

Sketches and answers travel as compressed arrays for each block and shard; an
answer is one bit for each entry sent. What is held at once is one block or one
shard, both of bounded size, however often a window repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import as_bytes, stored

#: Bytes of text, and documents, at which a block is full (one longer document is a block of its own).
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 50_000
#: Rows of the sketch, and cells of a row for each byte of text (about eight for each window).
DEPTH, CELLS = 2, 1.3
#: Cells of a shard of the sketch, and bytes of text for each shard of the second pass.
SHARD_BITS, SHARD_BYTES = 24, 16 << 20

_rng = np.random.default_rng(1970)
_FACTORS = _rng.integers(1, 1 << 63, (2, 1024), dtype=np.uint64) | np.uint64(1)
_ROW_FACTORS = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_NO_ID = np.iinfo(np.int64).max
_codec = pa.Codec("zstd", compression_level=1)


def _packed(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, then compressed."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return _codec.compress(raw, asbytes=True)


def _unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = _codec.decompress(data, decompressed_size=n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _rising(x: np.ndarray) -> bytes:
    return _packed(np.diff(x, prepend=x.dtype.type(0)))


def _risen(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.cumsum(_unpacked(data, n, kind), dtype=kind)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The windows of a block of documents, one after the other."""

    def __init__(self, payload: bytes, words: int):
        table = pa.ipc.open_stream(payload).read_all()
        self.ids = np.array([_NO_ID if i is None else i for i in table["id"].to_pylist()], dtype=np.int64)
        self.null = np.array([i is None for i in table["id"].to_pylist()], dtype=bool)
        self.texts = table["text"].to_pylist()
        self.size = words
        self.hashes, parts = [], []
        for text in self.texts:
            own = (text or b"").split()
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
            self.hashes.append(h)
            parts.append(self._sums(h, 0))
        self.counts = np.array([len(p) for p in parts], dtype=np.int64)
        self.windows = _mixed(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(parts)), self.counts)

    def _sums(self, h: np.ndarray, which: int) -> np.ndarray:
        n = len(h) - self.size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for k in range(self.size):
            total += h[k : k + n] * _FACTORS[which, k]
        return total

    def cells(self, row: int, bits: int) -> np.ndarray:
        return _mixed(self.windows * _ROW_FACTORS[row]) >> np.uint64(64 - bits)

    def repeated(self, answers: dict[int, bytes], bits: int, local: int) -> np.ndarray:
        """Positions of windows that all rows of the sketch count twice or more."""
        keep = np.ones(len(self.windows), dtype=bool)
        for row in range(DEPTH):
            cells, back = np.unique(self.cells(row, bits), return_inverse=True)
            keep &= _answered(cells, answers, row << 40, bits - local, bits)[back]
        return np.flatnonzero(keep)

    def keyed(self, at: np.ndarray):
        """(hash, second hash, smallest id) of the distinct windows at these positions, and for each position which it is."""
        start = np.concatenate([[0], np.cumsum(self.counts)])[:-1]
        all_words = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        word_start = np.concatenate([[0], np.cumsum([len(h) for h in self.hashes])])[:-1]
        own = self.owner[at]
        first = word_start[own] + at - start[own] if len(at) else at
        second = np.zeros(len(at), np.uint64)
        for k in range(self.size):
            second += all_words[first + k] * _FACTORS[1, k]
        second = _mixed(second)
        h, ids = self.windows[at], self.ids[own]
        order = np.lexsort((ids, second, h))
        new = np.ones(len(order), dtype=bool)
        if len(order):
            new[1:] = (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        lead = order[new]
        return h[lead], second[lead], ids[lead], which


def _answered(values: np.ndarray, answers: dict[int, bytes], base: int, shard_bits: int, bits: int) -> np.ndarray:
    """Bits of the answers, in the order of the sorted values sent."""
    shard = (values >> np.uint64(bits - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(values), np.int64)
    out = np.zeros(len(values), dtype=bool)
    for s, lo, hi in _runs(shard):
        out[lo:hi] = np.unpackbits(np.frombuffer(answers[base + s], np.uint8), count=hi - lo).astype(bool)
    return out


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_values):
        cut = np.flatnonzero(np.diff(sorted_values)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(sorted_values)], strict=True):
            yield int(sorted_values[lo]), lo, hi


def _to_blocks(most: int):
    return lambda batches: _blocked(batches, most)


def _blocked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    base, made = TaskContext.get().partitionId() << 32, 0
    ids, texts, size = [], [], 0

    def full() -> pa.RecordBatch:
        nonlocal made, ids, texts, size
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["id", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_codec)) as w:
            w.write_batch(batch)
        out = pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "bytes", "payload"])
        made, ids, texts, size = made + 1, [], [], 0
        return out

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            n = len(t) if t else 0
            if ids and (size + n > most or len(ids) >= BLOCK_DOCS):
                yield full()
            ids.append(i), texts.append(t)
            size += n
    if ids:
        yield full()


def _over_blocks(words: int, work: Callable[[Block, int, dict], pa.RecordBatch | None]):
    """work(block, id, answers by shard) for each row (block, payload[, answers])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                answers = {x["shard"]: x["bits"] for x in batch.column(2)[k].as_py() or ()} if batch.num_columns > 2 else {}
                made = work(Block(batch.column(1)[k].as_py(), words), batch.column(0)[k].as_py(), answers)
                if made is not None:
                    yield made

    return run


SENT = "shard long, block long, n long, a binary, b binary, c binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["shard", "block", "n", "a", "b", "c"])


def _sketch(bits: int, local_bits: int):
    shard_bits = bits - local_bits

    def work(block: Block, name: int, _) -> pa.RecordBatch:
        rows = []
        for row in range(DEPTH):
            cells, n = np.unique(block.cells(row, bits), return_counts=True)
            local = (cells & np.uint64((1 << local_bits) - 1)).astype(np.uint32)
            for s, lo, hi in _runs((cells >> np.uint64(bits - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(cells), np.int64)):
                rows.append(((row << 40) + s, name, hi - lo, _rising(local[lo:hi]), np.packbits(n[lo:hi] > 1).tobytes(), None))
        return _sent(rows)

    return work


def _merge_sketches(local_bits: int):
    return lambda group: _added(group, local_bits)


def _added(group: pa.Table, local_bits: int) -> pa.Table:
    """Add up the sketches of one shard; to each block, a bit for each of its cells: two or more."""
    counts = np.zeros(1 << local_bits, dtype=np.uint8)
    cells = [_risen(a, n, "<u4") for a, n in zip(group["a"].to_pylist(), group["n"].to_pylist(), strict=True)]
    for x, b in zip(cells, group["b"].to_pylist(), strict=True):
        counts[x] = np.minimum(counts[x] + 1 + np.unpackbits(np.frombuffer(b, np.uint8), count=len(x)), 2)
    return pa.table({"shard": group["shard"], "block": group["block"], "bits": pa.array([np.packbits(counts[x] > 1).tobytes() for x in cells], pa.binary())})


def _candidates(bits: int, local_bits: int, second_bits: int):
    def work(block: Block, name: int, answers: dict) -> pa.RecordBatch:
        h, second, ids, _ = block.keyed(block.repeated(answers, bits, local_bits))
        rows = []
        for s, lo, hi in _runs((h >> np.uint64(64 - second_bits)).astype(np.int64) if second_bits else np.zeros(len(h), np.int64)):
            rows.append(((DEPTH << 40) + s, name, hi - lo, _rising(h[lo:hi]), _packed(second[lo:hi]), _packed(ids[lo:hi])))
        return _sent(rows)

    return work


def _merge_candidates(group: pa.Table) -> pa.Table:
    """Group the windows of one shard by both hashes; to each block, a bit for each of its windows: a smaller id exists elsewhere."""
    sizes = group["n"].to_pylist()
    join = lambda column, f: np.concatenate([f(x, n) for x, n in zip(group[column].to_pylist(), sizes, strict=True)])
    h = join("a", lambda x, n: _risen(x, n, "<u8"))
    second = join("b", lambda x, n: _unpacked(x, n, "<u8"))
    ids = join("c", lambda x, n: _unpacked(x, n, "<i8"))
    order = np.lexsort((ids, second, h))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])
    least = np.empty(len(order), dtype=np.int64)
    least[order] = ids[order][new][np.cumsum(new) - 1]
    earlier = least < ids
    ends = np.cumsum(sizes)
    return pa.table({"shard": group["shard"], "block": group["block"], "bits": pa.array([np.packbits(earlier[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())})


def _remove(words: int, bits: int, local_bits: int, second_bits: int):
    def work(block: Block, name: int, answers: dict) -> pa.RecordBatch:
        at = block.repeated(answers, bits, local_bits)
        h, _, ids, which = block.keyed(at)
        elsewhere = _answered(h, answers, DEPTH << 40, second_bits, 64)
        own = block.owner[at]
        drop = np.zeros(len(block.windows), dtype=bool)
        drop[at] = (elsewhere[which] | (ids[which] < block.ids[own])) & ~block.null[own]
        n_words, n_removed, kept = [], [], []
        lo = 0
        for text, n in zip(block.texts, block.counts.tolist(), strict=True):
            own_words = (text or b"").split()
            hit = np.flatnonzero(drop[lo : lo + n])
            lo += n
            n_words.append(len(own_words))
            if len(hit):
                step = np.zeros(len(own_words) + 1, dtype=np.int32)
                np.add.at(step, hit, 1)
                np.add.at(step, hit + words, -1)
                covered = np.cumsum(step)[:-1] > 0
                n_removed.append(int(covered.sum()))
                own_words = [own_words[k] for k in np.flatnonzero(~covered).tolist()]
            else:
                n_removed.append(0)
            kept.append(b" ".join(own_words))
        ids_out = pa.array(block.ids, pa.int64(), mask=block.null)
        return pa.RecordBatch.from_arrays([ids_out, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return work


def remove_repeats(docs: DataFrame, words: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bits: int = SHARD_BITS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each input row: id, n_words, n_removed, kept (the words left, joined by one space).

    Words are split at ASCII white space and compared unchanged. A word goes if
    a window of ``words`` words covers it that also starts in a document with a
    smaller id; windows are judged on the input. Ids are integers.

    Null and empty texts have no words. Rows with a null id neither lose words
    nor make others lose any; rows that repeat an id are one document to each
    other. Other columns are ignored; an empty table gives no row. Windows are
    equal if 128 bits of two hashes of their words are.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = stored(slim.mapInArrow(_to_blocks(block_bytes), "block long, bytes long, payload binary"), "blocks")
    total = blocks.agg(F.sum("bytes")).head()[0] or 0
    bits = min(60, max(16, int(np.ceil(np.log2(max(1, total) * CELLS)))))
    local = min(bits, shard_bits)
    second_bits = max(0, int(np.ceil(np.log2(max(1, total / shard_bytes)))))
    parts = blocks.select("block", "payload")
    answer = "shard long, block long, bits binary"
    first = stored(parts.mapInArrow(_over_blocks(words, _sketch(bits, local)), SENT).groupBy("shard").applyInArrow(_merge_sketches(local), answer), "cells")

    def with_answers(answers: DataFrame) -> DataFrame:
        own = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("answers"))
        return parts.join(own, "block", "left")

    second = stored(with_answers(first).mapInArrow(_over_blocks(words, _candidates(bits, local, second_bits)), SENT).groupBy("shard").applyInArrow(_merge_candidates, answer), "windows")
    out = with_answers(first.unionAll(second)).mapInArrow(_over_blocks(words, _remove(words, bits, local, second_bits)), "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
