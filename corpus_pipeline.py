"""A training corpus from raw documents: five stages, each over all that the one before has kept.

A stage takes (spark, docs, sf_dir), docs with the columns of ``documents``, and
returns these columns again; the last returns the pieces of packed sequences.
Further columns pass through under any name. Rows with a null id are kept
unless their text is toxic or holds a benchmark passage; null and empty texts
are kept; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, near_dup, packing, secrets, toxicity
from quillspark.llm.common import clear_stored, crc_mod, stored, stored_tables, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labels outside the held-out third."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, the one with the smallest id stays."""
    return near_dup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with eight words in a row of any benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets and the linked parts of credentials are replaced, n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; a null text is its end id alone. No rows, no pieces."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dup", drop_near_duplicates), ("decontaminate", drop_benchmark), ("secrets", redact_secrets), ("pack", pack)]

#: No SQL expresses a trained classifier or a tokenizer; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage stored on the way goes once its result is written."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before = set(stored_tables(spark))
        docs = stored(stage(spark, docs, sf_dir), name)
        own = [p for p in stored_tables(spark) if p not in before]
        clear_stored(spark, [*own[:-1], *last])
        last = own[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
