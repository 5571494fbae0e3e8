"""Packing token sequences by vector bin packing with the dot-product heuristic."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import chunks
from quillspark.llm.common import crc32

#: Limits on a sequence: tokens, segments, loss-bearing tokens.
LIMITS = (2048, 256, 2048)
#: Examples that a task packs together, and the tokens at which it doesn't wait for so many.
BLOCK, BLOCK_TOKENS = 2048, 4_000_000


@dataclass
class Piece:
    example: int
    start: int
    length: int
    sequence: int
    offset: int


def pack(tokens: list[int], loss: list[int], limits: tuple[int, int, int] = LIMITS, cut: bool = True) -> list[Piece]:
    """Place examples into sequences under limits on tokens, segments and loss-bearing tokens.

    ``loss[i]`` counts the loss-bearing tokens of example i, which come last in
    it (a prompt precedes its answer). The open sequence takes, among the
    examples that fit, the one whose demand has the largest dot product with
    the free room, both in units of the limits. Where none fits and ``cut`` is
    set, the best example is cut to fill the room; without ``cut``, a longer
    example than the limit is an error. Examples of no tokens get no piece.
    The last sequence may stay open; see ``tail_sizes``.
    """
    cap = np.array(limits, dtype=np.float64)
    left = np.array(tokens, dtype=np.int64)
    start = np.zeros(len(left), dtype=np.int64)
    bearing = np.minimum(np.array(loss, dtype=np.int64), left) if len(left) else left.copy()
    if not cut and len(left) and (left.max() > limits[0] or bearing.max() > limits[2]):
        raise ValueError("an example exceeds the limits and may not be cut")
    pieces: list[Piece] = []
    alive = np.flatnonzero(left > 0)
    demand = np.stack([left / cap[0], np.full(len(left), 1 / cap[1]), bearing / cap[2]], axis=1) if len(left) else np.zeros((0, 3))
    sequence = -1
    room = np.zeros(3, dtype=np.int64)

    def place(i: int, n: int) -> None:
        nonlocal room
        prompt = int(left[i] - bearing[i])
        borne = max(0, n - prompt)
        pieces.append(Piece(int(i), int(start[i]), int(n), sequence, int(limits[0] - room[0])))
        room = room - np.array([n, 1, borne])
        start[i] += n
        left[i] -= n
        bearing[i] -= borne
        demand[i, 0], demand[i, 2] = left[i] / cap[0], bearing[i] / cap[2]

    def opened() -> None:
        nonlocal sequence, room
        sequence += 1
        room = np.array(limits, dtype=np.int64)

    for i in alive:  # whole sequences of long examples first
        while cut and left[i] >= limits[0] and min(limits[0], bearing[i]) <= limits[2]:
            opened()
            place(i, limits[0])
    alive = alive[left[alive] > 0]
    while len(alive):
        opened()
        while len(alive) and room[0] > 0 and room[1] > 0:
            fits = (left[alive] <= room[0]) & (bearing[alive] <= room[2])
            value = demand[alive] @ (room / cap)
            if fits.any():
                at = int(np.argmax(np.where(fits, value, -1)))
                place(alive[at], int(left[alive[at]]))
            elif cut:
                at = int(np.argmax(value))
                i = alive[at]
                n = int(min(room[0], left[i] - bearing[i] + room[2]))
                if n <= 0:
                    break
                place(i, n)
            else:
                break
            if left[alive[at]] == 0:
                alive = np.delete(alive, at)
    return pieces


def tail_sizes(n: int) -> list[int]:
    """Powers of two, falling, that sum to n: lengths that need no padding."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


#: Texts that are tokenized together, so that unknown words come to the tokenizer in long runs.
TOGETHER = 64
#: Stands alone between words when they are encoded in one call; a word that holds it is encoded by itself.
_BETWEEN = "\x01"


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class TokenBytes:
    """Little-endian 32-bit ids of texts, each with the end id, from a bounded table of words.

    Words that the table lacks are encoded in one call, as a text of its own
    with a mark between them. A word of letters with stops or commas behind it
    is two pre-tokens, and so the sum of both; letters alone are one pre-token,
    which goes to the tokenizer's model at once.
    """

    def __init__(self, tokenizer_path: str, end_id: int, most: int = 600_000):
        self.tokenizer = chunks.load(tokenizer_path)
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.known: dict[str, bytes] = {}
        self.most = most
        between = self._whole(_BETWEEN)
        self.mark = int(np.frombuffer(between, dtype="<u4")[0]) if len(between) == 4 else None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        model = self.tokenizer.model
        for w in words:
            if w.isalpha():
                units = w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS)
                self.known[w] = np.array([t.id for t in model.tokenize(units)], dtype="<u4").tobytes()
        words = [w for w in words if w not in self.known]
        joined = [w for w in words if _BETWEEN not in w and self.mark is not None]
        if joined:
            data = self._whole(f" {_BETWEEN} ".join(joined))
            ends = 4 * np.flatnonzero(np.frombuffer(data, dtype="<u4") == self.mark)
            if len(ends) == len(joined) - 1:
                starts = [0, *(ends + 4).tolist()]
                self.known.update(zip(joined, [data[s:e] for s, e in zip(starts, [*ends.tolist(), len(data)], strict=True)], strict=True))
        for w in words:
            if w not in self.known:
                self.known[w] = self._whole(w)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [chunks.worded_chunks(t or "") for t in texts]
        missing = set().union(*[x for x in split if x]).difference(self.known)
        if len(self.known) + len(missing) > self.most:
            self.known.clear()
            missing = set().union(*[x for x in split if x])
        long = {w for w in missing if len(w) > chunks.LONGEST}
        if long:  # these texts are encoded whole, so that the table's bytes stay bounded
            split = [None if x is None or not long.isdisjoint(x) else x for x in split]
            missing -= long
        parts, alone = {}, set()
        for w in missing:
            stem = w.rstrip(".,")
            if len(stem) < len(w) and stem.isalpha():
                parts[w] = stem, w[len(stem) :]
                alone.update(parts[w])
            else:
                alone.add(w)
        self._learn(sorted(alone.difference(self.known)))
        known = self.known
        for w, (stem, tail) in parts.items():
            known[w] = known[stem] + known[tail]
        return [(self._whole(t) if x is None else b"".join(map(known.__getitem__, x))) + self.end for t, x in zip(texts, split, strict=True)]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limits: tuple[int, int, int] = LIMITS, end_id: int = 1, keep_tokens: bool = False, prompt_col: str | None = None
) -> DataFrame:
    """Tokenize every text, cut and pack it; one row for each piece.

    A map without shuffle: each task packs what it reads, in blocks, and what
    a block leaves in an open sequence goes on to the next. A sequence that the
    limits on segments or loss close before it is full, and the open rest at a
    task's end, are laid out in sequences whose lengths are powers of two and
    so need no padding. sequence_id is the task's partition in the upper 31
    bits and a count in the lower 32, so a task that runs again after a loss
    gives the same rows.

    ``prompt_col`` holds instructions: their tokens come first and bear no
    loss, those of the text and the end id do. Without it all tokens bear loss,
    and the limit on loss repeats the one on tokens if both are equal.

    Null and empty texts have the end id alone (behind the prompt's ids); null
    ids and repeated rows are documents of their own; other columns are
    ignored; an empty table gives no row. ``keep_tokens`` adds the ids of each
    piece.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = TokenBytes(tokenizer_path, end_id)
        base = TaskContext.get().partitionId() << 32
        used = 0
        held: list[tuple] = []  # (id, doc_tokens, start, bytes, loss-bearing tokens) still to place

        def powers(parts: list[tuple]) -> Iterator[tuple]:
            """Parts one behind the other, in sequences of power-of-two lengths."""
            nonlocal used
            queue = parts[::-1]
            for size in tail_sizes(sum(len(x[3]) // 4 for x in parts)):
                at = 0
                while at < size:
                    i, total, first, data, _ = queue.pop()
                    n = min(size - at, len(data) // 4)
                    yield i, first, n, data[: 4 * n], total, base + used, at
                    at += n
                    if 4 * n < len(data):
                        queue.append((i, total, first + n, data[4 * n :], 0))
                used += 1

        def settle(last: bool) -> Iterable[tuple]:
            nonlocal used, held
            sizes = [len(x[3]) // 4 for x in held]
            sequences: dict[int, list[tuple]] = {}
            for p in pack(sizes, [x[4] for x in held], limits):
                i, total, first, data, bearing = held[p.example]
                loss = max(0, p.start + p.length - max(p.start, sizes[p.example] - bearing))
                sequences.setdefault(p.sequence, []).append((i, total, first + p.start, data[4 * p.start : 4 * (p.start + p.length)], loss))
            final, held = max(sequences, default=-1), []
            for key, parts in sequences.items():
                if sum(len(x[3]) // 4 for x in parts) == limits[0]:
                    at = 0
                    for i, total, first, data, _ in parts:
                        yield i, first, len(data) // 4, data, total, base + used, at
                        at += len(data) // 4
                    used += 1
                elif key == final and not last:
                    held = parts
                else:
                    yield from powers(parts)

        def rows(made: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
            made = list(made)
            if made:
                i, start, length, data, total, sequence, offset = zip(*made, strict=True)
                columns = [pa.array(i, id_type), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([crc32(x) for x in data], pa.int64()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if keep_tokens:
                    columns.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in data], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

        id_type, waiting = pa.int64(), 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                answers = ids_of(part.column(1).to_pylist())
                prompts = [x[: -len(ids_of.end)] for x in ids_of(part.column(2).to_pylist())] if prompt_col else [b""] * len(answers)
                for i, before, data in zip(part.column(0).to_pylist(), prompts, answers, strict=True):
                    held.append((i, (len(before) + len(data)) // 4, 0, before + data, len(data) // 4))
                    waiting += held[-1][1]
                if len(held) >= BLOCK or waiting >= BLOCK_TOKENS:
                    waiting = 0
                    yield from rows(settle(False))
        yield from rows(settle(True))

    slim = docs.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(n) for c, n in ((text_col, "text"), (prompt_col, "prompt")) if c])
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_tokens
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)
