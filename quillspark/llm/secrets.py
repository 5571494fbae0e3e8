"""Secrets in texts, and the linking of credential parts, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import helper_names, sized, stored

#: Kinds in the order in which spans at one place are listed. The first three are reported wherever they stand.
KINDS = ("assign", "access", "hex", "user", "blob", "endpoint")
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    "assign": rf"((?i:password|passwd|secret|token|api_?key)){_VALUE}([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "user": rf"((?i:user_?name|user|login|account|client_?id|key_?id)){_VALUE}([A-Za-z0-9@._-]{{3,}})",
    "blob": r"[A-Za-z0-9+/]{24,}={0,2}",
    "endpoint": r"""(?i:https?|ftp|ssh|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s"'<>|]+""",
}
#: A weak secret has all three.
_MIXED = r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"
#: Part of a credential that a kind stands for.
PARTS = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "identifier", "user": "identifier", "endpoint": "endpoint"}
#: The parts that must stand within scope of a weak candidate.
NEEDS = {"user": ("secret",), "blob": ("identifier",), "endpoint": ("identifier", "secret")}
#: Characters between two parts of one credential, at most.
SCOPE = 200


def _matches(kind: str, text: Column) -> Column:
    """Of each leftmost match: its number, the length of what stands between it and the one before, its own length, and whether it counts."""
    pattern = F.lit(PATTERNS[kind])
    marks = {"assign": ("=", ":"), "user": ("=", ":"), "access": ("AKIA",), "endpoint": ("://",)}.get(kind)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    if marks:  # no match without one of these
        some = F.lit(False)
        for m in marks:
            some = some | text.contains(m)
        found = F.when(some, found)
    counts = {
        "assign": lambda m: F.length(F.regexp_extract(m, PATTERNS[kind], 2)) >= 8,
        "access": lambda m: F.length(m) >= 16,
        "blob": lambda m: m.rlike(_MIXED),
    }.get(kind, lambda m: F.lit(True))
    gaps = F.when(F.size(found) > 0, F.split(text, PATTERNS[kind], -1))
    return F.transform(found, lambda m, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("len"), counts(m).alias("counts")))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h, l (hash and length of the text), kind, start, end, copies; one row of kind -1 for each document.

    Rows equal in id and text are one here; copies tells how many they are.
    Positions are code points. The pieces between and in the matches add up to
    them; that sum runs over the matches of one document and kind.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    itself = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(True).alias("counts")))
    none = F.slice(itself, 1, 0)
    rows = slim.select("id", F.xxhash64("text").alias("h"), F.length("text").alias("l"), F.explode(F.concat(itself, *[F.coalesce(_matches(k, text), none) for k in KINDS])).alias("m")).select("id", "h", "l", "m.*")
    once = rows.groupBy("id", "h", "l", "kind", "i", "gap", "len", "counts").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("id", "h", "l", "kind").orderBy("i")
    placed = once.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).withColumn("start", F.col("end") - F.col("len"))
    return placed.filter("counts").select("id", "h", "l", "kind", "start", "end", "copies")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates whose complementary parts stand within ``scope``, and which no plain finding overlaps.

    An interval join: spans meet in cells of ``scope`` characters of their document.
    """
    code = {k: KINDS.index(k) for k in KINDS}
    weak = found.filter(F.col("kind").isin(*[code[k] for k in NEEDS]))
    reach = lambda s: F.explode(F.sequence(F.floor((F.col("start") - s) / scope), F.floor((F.col("end") + s) / scope))).alias("cell")
    own = weak.select("id", "h", "l", "kind", "start", "end", F.floor(F.col("start") / scope).alias("cell"))
    keys = lambda r: (F.col("w.id").eqNullSafe(F.col(f"{r}.id"))) & (F.col("w.h") == F.col(f"{r}.h")) & F.col("w.l").eqNullSafe(F.col(f"{r}.l"))
    out = None
    for kind, needs in NEEDS.items():
        kept = own.filter(F.col("kind") == code[kind]).alias("w")
        for part in needs:
            other = found.filter(F.col("kind").isin(*[code[k] for k in KINDS if PARTS[k] == part])).select("id", "h", "l", "start", "end", reach(scope)).alias("o")
            near = (F.col("o.start") - F.col("w.end") <= scope) & (F.col("w.start") - F.col("o.end") <= scope)
            kept = kept.join(other, keys("o") & (F.col("w.cell") == F.col("o.cell")) & near, "left_semi").alias("w")
        out = kept if out is None else out.unionAll(kept)
    plain = found.filter(F.col("kind").between(0, 2)).select("id", "h", "l", "start", "end", reach(0)).alias("p")
    spread = out.select("id", "h", "l", "kind", "start", "end", reach(0)).alias("w")
    over = spread.join(plain, keys("p") & (F.col("w.cell") == F.col("p.cell")) & (F.col("p.start") < F.col("w.end")) & (F.col("w.start") < F.col("p.end")), "left_semi")
    over = over.select("id", "h", "l", "kind", "start", "end").distinct().alias("v")
    same = keys("v") & (F.col("w.kind") == F.col("v.kind")) & (F.col("w.start") == F.col("v.start")) & (F.col("w.end") == F.col("v.end"))
    return out.alias("w").join(over, same, "left_anti").select("id", "h", "l", "kind", "start", "end")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, keyed: bool = False) -> DataFrame:
    """One row for each input row: id, spans (array of start, kind, end, sorted by start, then kind).

    Assignments, access identifiers and long hexadecimal runs are reported
    wherever they stand; user names, mixed blobs and endpoints only where the
    parts that make a credential of them stand within ``scope`` characters.

    Null and empty texts have no spans; null ids and repeated rows stay; other
    columns are ignored; an empty table gives no row. ``keyed`` gives one row
    for equal rows, with the hash and length of the text.
    """
    found = stored(candidates(docs, id_col, text_col), "candidates")
    added = linked(found, scope).select("id", "h", "l", "kind", "start", "end", F.lit(0).cast("long").alias("copies"))
    told = found.filter(F.col("kind") <= 2).unionAll(added)
    span = F.when(F.col("kind") >= 0, F.struct("start", "kind", "end"))
    by_row = told.groupBy("id", "h", "l").agg(F.max(F.when(F.col("kind") == -1, F.col("copies"))).alias("copies"), F.array_sort(F.collect_list(span)).alias("spans"))
    if keyed:
        return by_row
    out = by_row.select(F.col("id").alias(id_col), "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def listed(spans: str, base: bool = False) -> Column:
    """kind:start:end of an array of spans, comma-joined; ``base`` leaves out what linking added."""
    names = F.array(*[F.lit(k) for k in KINDS])
    own = F.filter(spans, lambda x: x["kind"] <= 2) if base else F.col(spans)
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """All rows and columns of ``docs``; in the text, ``mark`` stands for every span. Overlapping spans are one.

    Null texts stay null and texts without spans as they are; null ids and
    repeated rows are redacted like others. Columns may have any names; an
    empty table stays empty.
    """
    name = helper_names(docs, "id", "h", "l", "spans")
    found = find_secrets(docs, id_col, text_col, scope, keyed=True).filter(F.size("spans") > 0)
    spans = sized(found.select(F.col("id").alias(name["id"]), F.col("h").alias(name["h"]), F.col("l").alias(name["l"]), _merged("spans").alias(name["spans"])), "spans")
    text, own = F.col(text_col).cast("string"), F.col(name["spans"])
    same = (F.xxhash64(text) == F.col(name["h"])) & F.length(text).eqNullSafe(F.col(name["l"])) & F.col(id_col).eqNullSafe(F.col(name["id"]))
    # what stands before each span, with the mark behind it, and what follows the last; put together once
    before = lambda i: F.coalesce(F.get(own, i - 1)["end"], F.lit(0).cast("long"))
    parts = F.transform(own, lambda x, i: F.concat(F.substr(text, (before(i) + 1).cast("int"), (x["start"] - before(i)).cast("int")), F.lit(mark)))
    rest = F.substr(text, (F.element_at(own, -1)["end"] + 1).cast("int"))
    made = F.array_join(F.array_append(parts, rest), "")
    return docs.join(spans, same, "left").withColumn(text_col, F.when(own.isNotNull(), made).otherwise(text)).select(*[f"`{c}`" for c in docs.columns])


def _merged(spans: str) -> Column:
    """Disjoint (start, end), sorted, that cover what the spans (sorted by start) cover; spans that only touch stay apart."""
    whole = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        wider = F.array_append(F.slice(done, 1, F.size(done) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")))
        apart = F.array_append(done, F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
        return F.when((F.size(done) > 0) & (x["start"] < last["end"]), wider).otherwise(apart)

    return F.aggregate(spans, whole, add)
