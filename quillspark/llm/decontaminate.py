"""Benchmark items inside documents: a prefix-filtered join of word windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import helper_names, sized, stored

#: What separates words, before A-Z are lower-cased (the letters A-Z are no separators then).
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of windows that one broadcast table holds at most; more windows are joined in several blocks.
BLOCK_BYTES = 4 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """Splitting at separators takes two thirds of the time of extracting the words."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN_WORDS), "")


def _plain(word: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(word, _UPPER, _LOWER)


def windows_of(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """wid, win (plain words), items (their ids as text): the distinct windows of all items.

    An item of fewer words than ``size``, but not none, is one window.
    """
    own = items.select(F.col(id_col).cast("string").alias("item"), F.transform(_words(F.col(text_col)), _plain).alias("w")).filter(F.size("w") > 0)
    each = own.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("at"))
    distinct = each.select("item", F.slice("w", F.col("at") + 1, size).alias("win")).groupBy("win").agg(F.collect_set("item").alias("items"))
    return stored(distinct.select(F.monotonically_increasing_id().alias("wid"), "win", "items"), "windows")


def _frequencies(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """key, n: how often each word of the vocabulary stands in all documents."""
    words = docs.select(F.explode(_words(F.col("text"))).alias("word")).select(F.lower("word").alias("key"))
    if small:  # few words go on from each task
        return words.join(F.broadcast(vocabulary), "key").groupBy("key").agg(F.count("*").alias("n"))
    return words.groupBy("key").agg(F.count("*").alias("n")).join(vocabulary, "key")


def prefixes(docs: DataFrame, windows: DataFrame) -> list[DataFrame]:
    """key, off, len, first and last word in lower case, joined words, wid, win, items: each window under its necessary prefix, in blocks of bounded size.

    All words of a window are necessary, so the prefix of the words ordered by
    rarity is the rarest one. Windows with a word that no document has fall out.
    """
    vocabulary = windows.select(F.explode("win").alias("word")).select(F.lower("word").alias("key")).distinct()
    size = vocabulary.agg(F.sum(F.octet_length("key") + 16)).head()[0] or 0
    counts = _frequencies(docs, vocabulary, size <= BLOCK_BYTES)
    each = windows.select("wid", F.posexplode("win").alias("off", "word")).select("wid", "off", F.lower("word").alias("key"))
    rarest = each.join(counts, "key", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off")).alias("r")).filter("r.n > 0")
    found = stored(rarest.join(windows, "wid").select("wid", "r.key", "r.off", F.size("win").alias("len"), F.lower(F.element_at("win", 1)).alias("first"), F.lower(F.element_at("win", -1)).alias("last"), F.array_join("win", " ").alias("joined"), "win", "items"), "prefixes")
    text = F.octet_length(F.array_join("win", " ")) + F.octet_length(F.array_join("items", " ")) + 16 * (F.size("win") + F.size("items")) + 40
    blocks = -(-(found.agg(F.sum(text)).head()[0] or 0) // BLOCK_BYTES)
    return [found if blocks <= 1 else found.filter(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == b) for b in range(max(1, blocks))]


def benchmark_hits(docs: DataFrame, items: DataFrame, size: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keyed: bool = False) -> DataFrame:
    """One row for each input row: id, n_words, hits (start and length of each occurrence of a window), n_hit (words inside), items (ids, sorted).

    Every word of every document probes the broadcast prefixes; a partner is
    kept if the window lies inside the document (positional and length bounds)
    and all its words are there. Matching needs A-Z lower-cased only; the
    comparison by lower() before it is a filter that loses nothing.

    Null and empty texts have no words, and items without words no window.
    Items with a null id mark words as hit but are not listed; repeated items
    count once. Null document ids and repeated rows stay; other columns are
    ignored; empty tables give no row, or rows without hits. ``keyed`` gives
    one row for equal rows, with the hash and length of the text.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = prefixes(slim, windows_of(items, size, item_col, item_text_col))
    start = F.col("pos") - F.col("off")
    # The filter runs for every word, so it is small enough to stay compiled: the ends of a window, then all its words as
    # one text. The document's words don't leave it with the rows that pass.
    ends = (F.lower(F.get("w", start)) == F.col("first")) & (F.lower(F.get("w", start + F.col("len") - 1)) == F.col("last"))
    same = _plain(F.array_join(F.slice("w", start + 1, F.col("len")), " ")) == F.col("joined")
    parts = None
    for block in blocks:
        # the last element stands for the document itself
        words = slim.select("id", F.xxhash64("text").alias("h"), F.length("text").alias("l"), _words(F.col("text")).alias("w"))
        words = words.select("id", "h", "l", "w", F.posexplode(F.array_append("w", F.lit(None).cast("string"))).alias("pos", "word")).withColumn("key", F.lower("word"))
        found = F.col("off").isNotNull() & (start >= 0) & (start + F.col("len") <= F.size("w")) & ends & same
        met = words.join(F.broadcast(block.select("key", "off", "len", "first", "last", "joined", "items")), "key", "left").filter(F.col("word").isNull() | found)
        own = met.select("id", "h", "l", F.when(F.col("word").isNull(), F.col("pos")).alias("n"), F.when(F.col("off").isNotNull(), F.struct(start.alias("start"), F.col("len").alias("length"))).alias("hit"), "items")
        parts = own if parts is None else parts.unionAll(own)
    # rows that are equal in id and text meet here
    by_row = parts.groupBy("id", "h", "l").agg(F.max("n").alias("n_words"), (F.count("n") / len(blocks)).cast("int").alias("copies"), F.collect_set("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    if keyed:
        return by_row
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
    out = by_row.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "hits", F.size(covered).cast("long").alias("n_hit"), "items", "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 8, least_items: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which windows of fewer than ``least_items`` items occur.

    Rows with a null id or text stay unless their text is hit; of equal rows
    all stay or all go. Columns may have any names; an empty table stays empty,
    and without items nothing goes.
    """
    name = helper_names(docs, "id", "h", "l")
    found = benchmark_hits(docs, items, size, id_col, text_col, keyed=True).filter(F.size("items") >= least_items)
    gone = sized(found.select(F.col("id").alias(name["id"]), F.col("h").alias(name["h"]), F.col("l").alias(name["l"])), "gone")
    text = F.col(text_col).cast("string")
    same = (F.xxhash64(text) == F.col(name["h"])) & F.length(text).eqNullSafe(F.col(name["l"])) & F.col(id_col).eqNullSafe(F.col(name["id"]))
    return docs.join(gone, same, "left_anti")


def _shingles(words: Column, size: int) -> Column:
    """The runs of ``size`` words of an array, each as one text; none if there are fewer."""
    at = F.sequence(F.lit(1), F.size(words) - size + 1)
    return F.when(F.size(words) >= size, F.transform(at, lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))


def contained_items(docs: DataFrame, items: DataFrame, share: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, containment): documents with a window, as long as the item, that holds ``share`` or more of its distinct shingles.

    A prefix-filtered set join: of an item with n shingles of which m must be
    there, one of the n - m + 1 rarest in all documents is. These prefixes, in
    broadcast blocks, meet the documents' shingles; then all windows around a
    meeting are compared whole. containment is the largest share among them.

    One row for each distinct document row and item. Texts and items with fewer
    words than a shingle have none and take no part, nor do null texts; null ids
    of documents stay, those of items are left out; repeated items count once.
    Other columns are ignored; empty tables give no row.
    """
    plain = lambda c: F.transform(_words(F.col(c)), _plain)
    own = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), plain(item_text_col).alias("iw")).select("item", F.size("iw").alias("n"), F.array_distinct(_shingles(F.col("iw"), shingle)).alias("s"))
    own = own.filter(F.size("s") > 0).distinct().withColumn("need", F.ceil(F.size("s") * F.lit(float(share)) - F.lit(1e-9)).cast("int"))
    own = stored(own.withColumn("iid", F.monotonically_increasing_id()), "items")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).distinct().select("id", F.xxhash64("text").alias("h"), F.length("text").alias("l"), _shingles(plain("text"), shingle).alias("d"))
    vocabulary = own.select(F.explode("s").alias("key")).distinct()
    size = vocabulary.agg(F.coalesce(F.sum(F.octet_length("key") + 16), F.lit(0))).head()[0]
    seen = texts.select(F.explode("d").alias("key"))
    counts = (seen.join(F.broadcast(vocabulary), "key") if size <= BLOCK_BYTES else seen.join(vocabulary, "key")).groupBy("key").agg(F.count("*").alias("c"))
    each = own.select("iid", "need", F.size("s").alias("m"), F.explode("s").alias("key")).join(counts, "key", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "key")))
    ranked = each.groupBy("iid", "need", "m").agg(order.alias("o")).select("iid", F.explode(F.slice("o", F.lit(1), F.col("m") - F.col("need") + 1)).alias("o"))
    prefix = stored(ranked.filter("o.c > 0").select("iid", F.col("o.key").alias("key")).join(own, "iid"), "prefixes")
    weight = F.octet_length("key") + F.octet_length(F.array_join("s", " ")) + 64
    blocks = max(1, -(-(prefix.agg(F.coalesce(F.sum(weight), F.lit(0))).head()[0]) // BLOCK_BYTES))
    room = F.greatest(F.size("d") - (F.col("n") - shingle), F.lit(1))  # last window's first shingle; a short text is one window
    starts = F.sequence(F.greatest(F.col("pos") + 1 - (F.col("n") - shingle), F.lit(1)), F.least(F.col("pos") + 1, room))
    held = F.transform(starts, lambda a: F.size(F.array_intersect(F.slice("d", a, F.col("n") - shingle + 1), F.col("s"))))
    found = None
    for b in range(blocks):
        part = prefix.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        probes = texts.select("id", "h", "l", "d", F.posexplode("d").alias("pos", "key"))
        met = probes.join(F.broadcast(part), "key").filter((F.size("d") >= F.col("need")) & (F.greatest(F.col("pos") + 1 - (F.col("n") - shingle), F.lit(1)) <= F.least(F.col("pos") + 1, room)))
        own_rows = met.select("id", "h", "l", "item", F.array_max(held).alias("k"), "need", F.size("s").alias("m")).filter("k >= need")
        found = own_rows if found is None else found.unionAll(own_rows)
    best = found.groupBy("id", "h", "l", "item").agg(F.max(F.col("k") / F.col("m")).alias("containment"))
    return best.select(F.col("id").alias(id_col), "item", "containment")
