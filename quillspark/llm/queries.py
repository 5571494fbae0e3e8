"""The queries op1_ to op10_ and ``pipeline``, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, near_dup, packing, quality, search, secrets, substring_dedup, token_counts, toxicity, url_rules
from quillspark.llm.common import crc_mod, table

#: The rules that op2 judges by.
RULES = [url_rules.Rule(*x) for x in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    ranker = quality.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs, ranker).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), RULES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), words=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), "threshold", "rejected")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda x: x["kind"])
    n = [F.size(F.filter(kinds, (lambda k: lambda x: x == k)(k))).cast("long").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *n, F.sha2(secrets.listed("spans", base=True).cast("binary"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.filter(F.col("doc_id") % 50 == 0), k=10)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.size("items") >= 2).alias("contaminated"))


OP2_SQL = r"""
WITH parts AS (
  SELECT page_id, instr(coalesce(url, ''), '://') AS at, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT s.*, r.rhost || r.rpath AS rule, r.verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, r.verdict DESC) AS k
  FROM split s LEFT JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""


OP4_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM split WHERE len(w) >= 13)),
least AS (SELECT win, min(doc_id) AS m FROM windows GROUP BY win HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS p FROM windows JOIN least USING (win) WHERE doc_id > m),
marked AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, CASE WHEN ps IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(ps, i)] END AS k
  FROM split LEFT JOIN marked USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""

OP7_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS p FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT id, b FROM reach JOIN links ON a = other),
least AS (SELECT id, min(other) AS c FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d JOIN least ON id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

OP10_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
own AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(list_slice(w, p, p + 7), ' ') AS win FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS p FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM own),
here AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM words, sizes WHERE len(w) >= n)),
met AS (SELECT doc_id, p, here.n, item_id FROM here JOIN own USING (win)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality, "op2_url_rules": op2_url_rules, "op3_packing": op3_packing, "op4_substring_dedup": op4_substring_dedup, "op5_toxicity": op5_toxicity, "op6_secrets": op6_secrets, "op7_near_dup": op7_near_dup, "op8_search": op8_search, "op9_token_counts": op9_token_counts, "op10_decontaminate": op10_decontaminate, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_rules": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op7_near_dup": OP7_SQL, "op10_decontaminate": OP10_SQL}
