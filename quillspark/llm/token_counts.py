"""Token counts by a map-side two-tier look-up."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import chunks

#: Entries of the broadcast table, each of chunks.LONGEST characters at most.
FREQUENT = 16_384
#: Texts, and bytes of each, from which the table is made. It decides about speed alone, never about a count.
SAMPLE, SAMPLE_BYTES = 4_000, 16_384


def frequent_lengths(docs: DataFrame, tokenizer_path: str, text_col: str = "text", entries: int = FREQUENT) -> dict[str, int]:
    """Token lengths of the most frequent pre-token chunks of SAMPLE texts (those that Spark reads first).

    The sample's texts come to the driver, SAMPLE x SAMPLE_BYTES at most, so no
    pre-token is shuffled and the table is read from a small part of the input.
    """
    text = F.col(text_col).cast("string")
    sample = docs.select(text.alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES).take(SAMPLE)
    seen: Counter = Counter()
    for r in sample:
        seen.update(chunks.spaced_chunks(r.text) or ())
    top = sorted((-n, c) for c, n in seen.items() if n > 1 and len(c) <= chunks.LONGEST)[:entries]
    tokenizer = chunks.load(tokenizer_path)
    return {c: len(tokenizer.encode(c, add_special_tokens=False).ids) for _, c in top}


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, frequent: dict[str, int] | None = None) -> DataFrame:
    """One row for each input row: id, n_bytes, n_tokens, over_limit.

    The first tier is a broadcast table of at most FREQUENT chunk lengths, the
    second a bounded cache in each worker, filled by the tokenizer itself. The
    plan is one map, without any exchange.
    Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows
    stay as they are; other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    if frequent is None:
        frequent = frequent_lengths(docs, tokenizer_path, text_col)
    tier = spark.sparkContext.broadcast(frequent)
    kind = dict(docs.dtypes)[id_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunks.load(tokenizer_path)
        length = lambda x: len(tokenizer.encode(x, add_special_tokens=False).ids)
        look = chunks.Table(length, tier.value).__getitem__
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                parts = chunks.spaced_chunks(text)
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                counts.append(length(text) if parts is None else sum(map(look, parts)) if text else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([x > limit for x in counts], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
