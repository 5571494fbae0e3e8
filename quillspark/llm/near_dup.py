"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import as_bytes, helper_names, sized, stored

BINS, BANDS = 128, 32
ROWS = BINS // BANDS
#: A pair of large sets whose signatures agree in a smaller share than this is no candidate: at a
#: similarity of 0.8 that lies over five standard deviations away. Small sets are always compared.
LEAST_AGREEMENT, SMALL_SET = 0.6, 64

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20170806)
_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: For each bin, the order in which it looks for a bin to copy from: a permutation of its own.
_PROBES = np.stack([_rng.permutation(BINS) for _ in range(BINS)])
_BAND_FACTORS = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: A-Z lower-cased, words split at ASCII white space.

    A text with fewer words than a shingle has its whole word sequence as the only one.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += h[i : i + n] * _FACTORS[i]
    return np.unique(mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One permutation, BINS bins by the leading bits, the smallest value of each; an empty bin copies from a full one.

    The sets are sorted and their values uniform, so a bin is a run and its
    first value the smallest. Every empty bin probes the bins in a random order
    of its own, which makes the copies independent (optimal densification).
    """
    edges = np.searchsorted(shingles, (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)))
    full = np.diff(np.append(edges, len(shingles))) > 0
    own = np.where(full, np.arange(BINS), _PROBES[np.arange(BINS), np.argmax(full[_PROBES], axis=1)])
    return shingles[edges[own]]


def band_keys(sig: np.ndarray) -> np.ndarray:
    return mixed((sig.reshape(BANDS, ROWS) * _BAND_FACTORS).sum(axis=1) + np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX).view(np.int64)


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), n_shingles, set_key (128 bits of the whole set), sig (a byte for each bin), bands; the last three null for texts without words."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs, bands = [], [], [], []
            for text in as_bytes(batch.column(2)):
                s = shingle_set(text, words)
                n.append(len(s))
                if not len(s):
                    keys.append(None), sigs.append(None), bands.append(None)
                    continue
                sig = signature(s)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append((mixed(sig) & np.uint64(255)).astype(np.uint8).tobytes())
                bands.append(band_keys(sig))
            made = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "th", "n_shingles", "set_key", "sig", "bands"])

    slim = _slim(docs, id_col, text_col)
    return slim.mapInArrow(run, f"id {kind}, th long, n_shingles long, set_key binary, sig binary, bands array<bigint>")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


#: Buckets of so many classes or fewer are compared pair by pair, which bounds the pairs by a multiple of the members.
PAIRWISE = 16
#: Hubs of each larger bucket in further rounds.
HUBS = 4
#: Documents of a block, and bytes of their texts, about which blocks are compared (one longer text is a block of its own).
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Shingle sets of blocks that a task keeps for the next pairs of blocks.
KEPT_BLOCKS = 4
#: Classes of so many rows or more are looked up apart from the others, so that no task gets all their rows.
MANY_ROWS = 200


def _pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b, of buckets of PAIRWISE members at most; sizes that rule a similarity out are left out.

    members: key, id, n, of such buckets.
    """
    groups = members.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("m"))
    left = groups.select("m", F.posexplode("m").alias("i", "x"))
    return left.select("x", F.explode(F.slice("m", F.col("i") + 2, PAIRWISE)).alias("y")).select(F.col("x.id").alias("a"), F.col("x.n").alias("na"), F.col("y.id").alias("b"), F.col("y.n").alias("nb"))


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose set sizes allow the similarity."""
    fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return pairs.filter((F.col("a") != F.col("b")) & fit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity: 100 x intersection >= percent x union.

    texts: id, n, sig, text, one row for each id. Signatures of large sets that agree too seldom spare the sets.
    """
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[tuple, np.ndarray] = OrderedDict()

        def own(i, text) -> np.ndarray:
            if i not in kept:
                kept[i] = shingle_set(text, words)
                if len(kept) > 32:
                    kept.popitem(last=False)
            else:
                kept.move_to_end(i)
            return kept[i]

        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(i).to_pylist() for i in range(6))
            ta, tb = as_bytes(batch.column(6)), as_bytes(batch.column(7))
            found = []
            for i in range(batch.num_rows):
                if min(na[i], nb[i]) >= SMALL_SET and np.mean(np.frombuffer(sa[i], np.uint8) == np.frombuffer(sb[i], np.uint8)) < LEAST_AGREEMENT:
                    continue
                x, y = own(a[i], ta[i]), own(b[i], tb[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found, pa.int64())), batch.column(1).take(pa.array(found, pa.int64()))], names=["a", "b"])

    ends = lambda s: texts.select(*[F.col(c).alias(c + s) for c in ("id", "n", "sig", "text")])
    full = pairs.join(ends("_b"), F.col("b") == F.col("id_b")).join(ends("_a"), F.col("a") == F.col("id_a"))
    return full.select("a", "b", "n_a", "n_b", "sig_a", "sig_b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def _blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """id, component, n, sig, text, keys (its buckets), block: each member in one block of about BLOCK members at most.

    members: key, id, component. A member's home is the largest of its buckets. A component that has
    many members in one home has blocks of its own there; the others share blocks.
    """
    held = members.groupBy("key").agg(F.count("*").alias("c"))
    own = members.join(held, "key").groupBy("id").agg(F.max(F.struct("c", "key")).alias("home"), F.collect_set("key").alias("keys"), F.min("component").alias("component"))
    each = own.select("id", "keys", "component", F.col("home.key").alias("home")).join(texts, "id").withColumn("size", F.octet_length("text").cast("long"))
    each = stored(each, "members")
    parts = lambda: F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES)).alias("parts")
    by_component = each.groupBy("home", "component").agg(F.count("*").alias("m"), parts())
    large = by_component.filter(F.col("m") * 2 >= BLOCK).select("home", "component", F.col("parts").alias("own_parts"))
    each = each.join(large, ["home", "component"], "left")
    shared = each.filter("own_parts is null").groupBy("home").agg(parts())
    part = F.when(F.col("own_parts").isNull(), F.pmod(F.xxhash64("component"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("id"), F.col("own_parts")))
    block = F.xxhash64("home", F.when(F.col("own_parts").isNotNull(), F.col("component")), part)
    return stored(each.join(shared, "home", "left").select("id", "component", "n", "sig", "text", "keys", block.alias("block")), "blocks")


def _compare(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, tuple] = OrderedDict()

        def block(key: int, rows: pa.StructArray) -> tuple:
            if key not in kept:
                sets = [shingle_set(t, words) for t in as_bytes(rows.field("text"))]
                sig = np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint8).reshape(len(rows), BINS)
                kept[key] = rows.field("id").to_pylist(), rows.field("component").to_pylist(), rows.field("n").to_numpy(), sig, rows.field("keys").to_pylist(), sets
                if len(kept) > KEPT_BLOCKS:
                    kept.popitem(last=False)
            else:
                kept.move_to_end(key)
            return kept[key]

        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                x, y = (block(batch.column(c)[i].as_py(), batch.column(c + 1)[i].values) for c in (0, 2))
                for p, q in _linked(x, y, x is y, percent):
                    a.append(min(x[0][p], y[0][q])), b.append(max(x[0][p], y[0][q]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _linked(x: tuple, y: tuple, same: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Links between members of two blocks that share a bucket; pairs that stand in one component by then are passed over."""
    (_, cx, nx, sx, kx, tx), (_, cy, ny, sy, ky, ty) = x, y
    root: dict = {c: c for c in [*cx, *cy]}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    names = {k: i for i, k in enumerate({k for keys in kx for k in keys} & {k for keys in ky for k in keys})}

    def buckets(rows: list) -> np.ndarray:
        at = [(i, names[k]) for i, keys in enumerate(rows) for k in keys if k in names]
        held = np.zeros((len(rows), len(names)), np.float32)
        held[[i for i, _ in at], [k for _, k in at]] = 1
        return held

    meet = (buckets(kx) @ buckets(ky).T > 0) & (np.minimum.outer(nx, ny) * 100 >= np.maximum.outer(nx, ny) * percent)
    if same:
        meet = np.triu(meet, 1)
    if not meet.any():
        return
    sizes = np.array([len(t) for t in ty])
    tokens, spot = np.unique(np.concatenate(ty), return_inverse=True)
    ends = np.cumsum(sizes)
    here = np.zeros(len(tokens) + 1, bool)
    for p in np.flatnonzero(meet.any(axis=1)).tolist():
        other = np.flatnonzero(meet[p])
        alike = (sy[other] == sx[p]).mean(axis=1) >= LEAST_AGREEMENT
        other = other[alike | (np.minimum(nx[p], ny[other]) < SMALL_SET)]
        other = np.array([q for q in other.tolist() if top(cx[p]) != top(cy[q])], np.int64)
        if not len(other):
            continue
        at = np.searchsorted(tokens, tx[p])
        at[at == len(tokens)] = 0
        at = at[tokens[at] == tx[p]]
        here[at] = True
        runs = sizes[other]
        own = np.repeat(ends[other] - np.cumsum(runs), runs) + np.arange(runs.sum())
        both = np.add.reduceat(here[spot[own]].astype(np.int64), np.cumsum(runs) - runs)
        here[at] = False
        for q in other[100 * both >= percent * (nx[p] + ny[other] - both)].tolist():
            if top(cx[p]) != top(cy[q]):
                root[top(cx[p])] = top(cy[q])
                yield p, q


def crossing_links(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b), a < b: links that join all members of different components that share a bucket and reach the similarity.

    members: key, id, component, of buckets that hold several components. Pairs of blocks that share a
    bucket meet, once each, and are compared inside a task on whole sets; only links leave it, and of
    those no more than join the components there.
    """
    blocks = _blocks(members, texts)
    there = blocks.select("block", "component", F.explode("keys").alias("key")).groupBy("key", "block").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    side = lambda s: there.select("key", *[F.col(c).alias(c + s) for c in ("block", "x", "y")])
    several = ~((F.col("x_a") == F.col("y_a")) & (F.col("x_b") == F.col("y_b")) & (F.col("x_a") == F.col("x_b")))
    met = side("_a").join(side("_b"), "key").filter((F.col("block_a") <= F.col("block_b")) & several).select(F.col("block_a").alias("a"), F.col("block_b").alias("b")).distinct()
    rows = stored(blocks.groupBy("block").agg(F.collect_list(F.struct("id", "component", "n", "sig", "text", "keys")).alias("rows")), "packed")
    full = met.join(rows.toDF("a", "rows_a"), "a").join(rows.toDF("b", "rows_b"), "b").select("a", "rows_a", "b", "rows_b")
    return full.mapInArrow(_compare(words, percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of an edge (a, b) reaches.

    Alternates stars of large and small neighbours, so chains of n edges take
    about log n rounds. Edges are cut from their lineage after each round;
    nothing but two numbers comes to the driver.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    seen = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("x"), "m").filter("x <> m").unionAll(small_least.select("a", "m")).toDF("a", "b").distinct()
        now = stored(small, "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that are near duplicates of a smaller id. Of rows that repeat an id one stays.

    Rows with a null id stay, texts without words (null, empty) are nobody's
    duplicates. Columns may have any names; an empty table stays empty.
    """
    found = near_duplicates(docs, words, percent, id_col, text_col)
    name = helper_names(docs, "gone", "rank")
    gone = sized(found.filter(~F.col("kept")).select(F.col(id_col).alias(name["gone"])).distinct(), "gone")
    rest = docs.join(gone, docs[id_col] == gone[name["gone"]], "left_anti")
    repeated = sized(found.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(name["gone"])).count().filter("count > 1").select(name["gone"]), "repeated")
    if repeated.isEmpty():
        return rest
    many = rest.join(repeated, rest[id_col] == repeated[name["gone"]], "left_semi")
    many = many.withColumn(name["rank"], F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))).filter(F.col(name["rank"]) == 1).drop(name["rank"])
    return rest.join(repeated, rest[id_col] == repeated[name["gone"]], "left_anti").unionAll(many)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_shingles, component_id, kept.

    Documents whose shingle sets have a Jaccard similarity of ``percent`` or
    more are linked; component_id is the smallest id reachable over links, and
    the document that bears it is kept. Documents with equal sets form a class
    and only one text of it goes on. Candidates are all pairs in small buckets
    and a star in each larger one. Where larger buckets still hold several
    components, stars with other hubs follow for as long as they halve the
    components, and then all members of different components that share a
    bucket are compared in blocks. Every link is confirmed on the whole sets.

    Texts without words, null ones included, are linked with nothing. Rows
    with a null id take no part: their component is null and they are kept.
    Rows that repeat an id are one document that has the links of all its
    texts. Other columns are ignored; an empty table gives no row.
    """
    sketch = stored(sketches(docs, words, id_col, text_col), "sketches")
    some = sketch.filter(F.col("id").isNotNull() & F.col("set_key").isNotNull())
    # a class is a set, known by a number of its own; the row of its smallest id lends it a text
    classes = some.groupBy("set_key").agg(F.min(F.struct("id", "th")).alias("r"), F.count("*").alias("rows"))
    classes = stored(classes.select("set_key", F.monotonically_increasing_id().alias("node"), F.col("r.id").alias("rep"), F.col("r.th").alias("th"), "rows"), "classes")
    lent = classes.select(F.col("set_key").alias("k"), "node", F.col("rep").alias("id"), "th")
    reps = stored(some.join(lent, ["id", "th"]).filter("k = set_key").select(F.col("node").alias("id"), F.col("id").alias("rep"), "th", F.col("n_shingles").alias("n"), "sig", "bands").dropDuplicates(["id"]), "representatives")
    bands = reps.select("id", "n", F.explode("bands").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("hub")).filter("c > 1")
    members = stored(bands.join(sizes, "key"), "buckets")
    hubs = members.filter((F.col("c") > PAIRWISE) & (F.col("id") == F.col("hub"))).select("key", F.col("id").alias("a"), F.col("n").alias("na"))
    stars = members.filter(F.col("c") > PAIRWISE).select("key", F.col("id").alias("b"), F.col("n").alias("nb")).join(hubs, "key").select("a", "na", "b", "nb")
    pairs = stored(_sized(_pairs(members.filter(F.col("c") <= PAIRWISE).select("key", "id", "n")).unionAll(stars), percent), "pairs")
    own = reps.select("id", "rep", "th", "n", "sig").join(members.select("id").distinct(), "id", "left_semi")
    slim = _slim(docs, id_col, text_col).withColumnRenamed("id", "rep")
    texts = stored(slim.join(own, ["rep", "th"]).select("id", "n", "sig", "text").dropDuplicates(["id"]), "texts")
    links = stored(confirmed(pairs, texts, words, percent), "links")
    marks = components(links)
    large, left, turn = members.filter(F.col("c") > PAIRWISE).select("key", "id", "n"), None, 0
    while True:
        turn += 1
        known = stored(large.join(marks, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component")), "known")
        several = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
        known = stored(known.join(several, "key", "left_semi"), "mixed")
        ids, now = known.agg(F.approx_count_distinct("id"), F.approx_count_distinct("component")).head()
        if not now:
            break
        if 2 * now > (ids if left is None else left):  # stars no longer halve the components
            links = links.unionAll(stored(crossing_links(known.select("key", "id", "component"), texts, words, percent), "links"))
            break
        left = now
        first = known.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("id", "key", F.lit(HUBS * turn + k)).alias("h"), "id", "n", "component")).alias(f"h{k}") for k in range(HUBS)])
        hubs = first.select("key", F.explode(F.array(*[f"h{k}" for k in range(HUBS)])).alias("h")).select("key", F.col("h.id").alias("a"), F.col("h.n").alias("na"), F.col("h.component").alias("ca")).distinct()
        crossing = known.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), "component").join(hubs, "key").filter("ca <> component").select("a", "na", "b", "nb")
        links = links.unionAll(stored(confirmed(stored(_sized(crossing, percent), "pairs"), texts, words, percent), "links"))
        marks = components(links)
        large = known.select("key", "id", "n")
    # classes that one id's texts stand in are one document
    ids = some.join(classes.select("set_key", "node"), "set_key").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.collect_set("node").alias("all")).filter("a <> z")
    marks = components(links.unionAll(ids.select("a", F.explode("all").alias("b")).filter("a <> b")))
    joined = classes.join(marks, F.col("node") == F.col("id"), "left").select("set_key", "rep", "rows", F.coalesce("component", "node").alias("component"))
    least = joined.groupBy("component").agg(F.min("rep").alias("least"))
    found = stored(joined.join(least, "component").select("set_key", "least", "rows"), "components")
    often = sized(found.filter(F.col("rows") >= MANY_ROWS).select(F.col("set_key").alias("often_key"), F.col("least").alias("often")), "often")
    slim = sketch.select("id", "th", "n_shingles", "set_key").join(often, F.col("set_key") == F.col("often_key"), "left")
    # rows that need no look-up go to all tasks alike, by a key that no class has
    spread = slim.withColumn("key", F.when(F.col("set_key").isNull() | F.col("often").isNotNull(), F.encode(F.xxhash64("id", "th").cast("string"), "UTF-8")).otherwise(F.col("set_key")))
    out = spread.join(found.filter(F.col("rows") < MANY_ROWS).select(F.col("set_key").alias("key"), "least"), "key", "left")
    whole = F.when(F.col("id").isNotNull(), F.coalesce("often", "least", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", whole.alias("component_id"), F.coalesce(F.col("id") == whole, F.lit(True)).alias("kept"))
