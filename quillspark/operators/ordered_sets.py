"""Exact percentiles and modes of groups of any size: no task reads all the values of a large group."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.expr import OrderedSet, OrderedSets, column

#: So many of the largest groups are narrowed; each further one has at most a like part of the rows and is left to Spark's aggregate.
LARGEST = 1024
#: Accuracy of the sketches (their size grows with it) and the margin around a fraction, twice their error.
ACCURACY, MARGIN = 1000, 0.002


def _one_content(df: DataFrame) -> bool:
    """Whether each pass over ``df`` sees the same rows: no stream, no random values, no LIMIT that may take others."""
    plan = df._jdf.queryExecution().analyzed()
    return not df.isStreaming and plan.deterministic() and not re.search(r"^\W*(GlobalLimit|LocalLimit|Offset|Tail|Sample)\b", plan.toString(), re.M)


def _apart(s: OrderedSet, kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType) if s.parts[0] != "mode" else isinstance(kind, T.AtomicType)


def aggregate(df: DataFrame, keys: list[Column], aggregates: tuple) -> DataFrame:
    """``df.groupBy(keys).agg(aggregates)`` with the ordered-set aggregates worked out apart, in three passes over narrow rows:

    sketches bound the value at each rank, counts tell exactly which side of the
    bounds holds it, and only the different values of that side are ranked. The
    sketches decide about the number of these values, not about the result.
    """
    native = df.groupBy(*keys).agg(*[column(a) for a in aggregates])
    names = native.columns
    found: list[OrderedSet] = list(dict.fromkeys(s for a in aggregates if isinstance(a, OrderedSets) for s in a.sets))
    if not found or len(set(names)) < len(names):
        return native
    n_keys = len(keys)
    ks = [f"__k{i}" for i in range(n_keys)]
    args = list(dict.fromkeys(s.parts[1] for s in found))
    flat = df.select(*[k.alias(x) for k, x in zip(keys, ks)], *[F.expr(a).alias(f"__v{j}") for j, a in enumerate(args)])
    kinds = dict(zip(args, [flat.schema[f"__v{j}"].dataType for j in range(len(args))]))
    if not all(isinstance(flat.schema[k].dataType, T.AtomicType) for k in ks) or not all(_apart(s, kinds[s.parts[1]]) for s in found) or not _one_content(df):
        return native

    sides: list[DataFrame] = []
    values: dict[OrderedSet, Column] = {}
    kept: list[tuple[Column, str]] = []
    ranked = [s for s in found if s.parts[0] != "mode"]
    source = df
    if ranked:
        large = _largest(flat, ks, args, ranked)
        sides.append(F.broadcast(_ranked(flat, ks, args, ranked, large)))
        # the other groups' values, by Spark's aggregate; of a large group they are null
        hot = F.broadcast(large.select(*[F.col(k).alias(f"{k}h") for k in ks], F.lit(True).alias("__hot")))
        source = df.join(hot, _same([(k, F.col(f"{x}h")) for k, x in zip(keys, ks)]), "left")
        for i, s in enumerate(ranked):
            name, _, fraction = s.parts
            cold = F.expr(f"{name}({float(fraction)}) WITHIN GROUP (ORDER BY CASE WHEN __hot IS NULL THEN {s.parts[1]} END {s.way})")
            kept.append((cold, f"__cold{i}"))
            values[s] = F.coalesce(F.col(f"__r{i}"), F.col(f"__cold{i}"))
    for i, s in enumerate(x for x in found if x.parts[0] == "mode"):
        sides.append(_mode(flat, ks, f"__v{args.index(s.parts[1])}", s.way == "DESC", f"__m{i}"))
        values[s] = F.col(f"__m{i}")
    plain = [(column(a), f"__a{i}") for i, a in enumerate(aggregates) if not isinstance(a, OrderedSets)]
    out = source.groupBy(*keys).agg(*[c.alias(x) for c, x in [*plain, *kept, (F.count("*"), "__n")]])
    own = [F.col(f"`{x}`") for x in names[:n_keys]]
    for k, side in enumerate(sides):
        right = side.withColumnsRenamed({x: f"{x}s{k}" for x in ks})
        out = out.join(right, _same([(o, F.col(f"{x}s{k}")) for o, x in zip(own, ks)]), "left")
    made = [column(a.rebuilt(values)) if isinstance(a, OrderedSets) else F.col(f"__a{i}") for i, a in enumerate(aggregates)]
    return out.select(*own, *[m.alias(x) for m, x in zip(made, names[n_keys:])])


def _same(pairs: list[tuple[Column, Column]]) -> Column:
    c = F.lit(True)
    for a, b in pairs:
        c = c & a.eqNullSafe(b)
    return c


def _largest(flat: DataFrame, ks: list[str], args: list[str], ranked: list[OrderedSet]) -> DataFrame:
    """The largest groups, with bounds around the value of each percentile."""
    sketches, bounds = [], []
    for j, a in enumerate(args):
        mine = [(i, s.parts[2] if s.way == "ASC" else 1 - s.parts[2]) for i, s in enumerate(ranked) if s.parts[1] == a]
        if mine:
            ends = [F.lit(float(x)) for _, p in mine for x in (max(p - MARGIN, 0), min(p + MARGIN, 1))]
            sketches.append(F.percentile_approx(F.col(f"__v{j}").cast("double"), F.array(*ends), ACCURACY).alias(f"__q{j}"))
            for at, (i, _) in enumerate(mine):
                bounds += [F.col(f"__q{j}")[2 * at].alias(f"__low{i}"), F.col(f"__q{j}")[2 * at + 1].alias(f"__high{i}")]
    groups = flat.groupBy(*ks).agg(F.count("*").alias("__rows"), *sketches)
    return groups.orderBy(F.desc("__rows"), *ks).limit(LARGEST).select(*ks, *bounds)


def _ranked(flat: DataFrame, ks: list[str], args: list[str], ranked: list[OrderedSet], large: DataFrame) -> DataFrame:
    """A row for each large group with values: its percentiles as __r0, __r1, ..."""
    used = [f"__v{args.index(s.parts[1])}" for s in ranked]
    narrow = flat.select(*ks, *[F.col(v).cast("double").alias(v) for v in dict.fromkeys(used)])
    sets = range(len(ranked))
    bounds = [f"__{b}{i}" for i in sets for b in ("low", "high")]

    def met(other: DataFrame) -> DataFrame:
        right = other.withColumnsRenamed({k: f"{k}b" for k in ks})
        return narrow.join(F.broadcast(right), _same([(F.col(k), F.col(f"{k}b")) for k in ks])).drop(*[f"{k}b" for k in ks])

    counts = [F.count(F.when(c, 1)).alias(x) for i, v in zip(sets, used) for c, x in ((F.col(v).isNotNull(), f"__n{i}"), (F.col(v) < F.col(f"__low{i}"), f"__below{i}"), (F.col(v) <= F.col(f"__high{i}"), f"__upto{i}"))]
    counted = met(large).groupBy(*ks, *bounds).agg(*counts)
    wanted = []
    for i, s in zip(sets, ranked):
        name, _, p = s.parts
        n = F.col(f"__n{i}")
        at = n.cast("double") * p if name == "percentile_disc" else (n - 1).cast("double") * p
        lower, upper = (F.greatest(F.ceil(at), F.lit(1)) - 1,) * 2 if name == "percentile_disc" else (F.floor(at), F.ceil(at))
        # ranks among rising values
        one, two = (n - 1 - lower, n - 1 - upper) if s.way == "DESC" else (lower, upper)
        first, last, below, upto = F.least(one, two), F.greatest(one, two), F.col(f"__below{i}"), F.col(f"__upto{i}")
        base = F.when(first >= upto, upto).when(first >= below, below).otherwise(F.lit(0))
        after = F.when(first >= upto, 2).when(first >= below, 1).otherwise(0)
        until = F.when(last < below, 0).when(last < upto, 1).otherwise(2)
        wanted.append(F.struct(F.lit(i).alias("i"), base.cast("long").alias("base"), one.cast("long").alias("one"), two.cast("long").alias("two"), (at - lower).alias("rest"), (upper - at).alias("lack"), after.alias("after"), until.alias("until")).alias(f"__w{i}"))
    chosen = met(counted.select(*ks, *bounds, *wanted))
    takes = []
    for i, v in zip(sets, used):
        side = F.when(F.col(v) < F.col(f"__low{i}"), 0).when(F.col(v) <= F.col(f"__high{i}"), 1).otherwise(2)
        takes.append(F.col(v).isNotNull() & side.between(F.col(f"__w{i}.after"), F.col(f"__w{i}.until")))
    some = takes[0]
    for t in takes[1:]:
        some = some | t
    each = F.array_compact(F.array(*[F.when(t, F.struct(F.col(f"__w{i}").alias("w"), F.col(v).alias("v"))) for i, v, t in zip(sets, used, takes)]))
    rows = chosen.filter(some).select(*ks, F.explode(each).alias("__x")).groupBy(*ks, F.col("__x.w").alias("__w"), F.col("__x.v").alias("__v")).count()
    upto = F.col("__w.base") + F.sum("count").over(Window.partitionBy(*ks, "__w").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("__upto", upto).withColumn("__from", F.col("__upto") - F.col("count"))
    here = lambda rank: (F.col("__from") <= F.col(f"__w.{rank}")) & (F.col(f"__w.{rank}") < F.col("__upto"))
    picked = placed.groupBy(*ks, "__w").agg(F.max(F.when(here("one"), F.col("__v"))).alias("a"), F.max(F.when(here("two"), F.col("__v"))).alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("__w.lack") * F.col("a") + F.col("__w.rest") * F.col("b"))
    return picked.groupBy(*ks).agg(*[F.max(F.when(F.col("__w.i") == i, value)).alias(f"__r{i}") for i in sets])


def _mode(flat: DataFrame, ks: list[str], value: str, down: bool, name: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the first in the order."""
    n = flat.filter(F.col(value).isNotNull()).groupBy(*ks, value).count()
    best = F.max_by(value, F.struct("count", value)) if down else F.min_by(value, F.struct(-F.col("count"), F.col(value)))
    return n.groupBy(*ks).agg(best.alias(name))
