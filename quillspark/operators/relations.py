"""Loading of related rows as nested columns, counts of them, and paging within each parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.errors import QuillError
from quillspark.functions.expr import order_of
from quillspark.sources.entity import Entity


def related(catalog, entity: Entity, name: str, with_deleted: bool = False) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Rows at the other end of a relation, scoped, and the pairs (own property, column of these rows) that link them.

    Keys have one column or several. Rows through a bridge have the owner's key as ``__owner`` (``__owner_0`` and on).
    """
    relation = entity.relations[name]
    target = catalog.entity(relation.target)
    rows = catalog.scan(target, with_deleted)
    if relation.kind == "many_to_one" or relation.kind == "one_to_one" and not relation.inverse:
        return rows, _paired(entity, names(relation.key), target.key)
    if relation.kind in ("one_to_many", "one_to_one"):
        return rows, _paired(entity, entity.key, names(relation.key))
    if relation.kind == "many_to_many":
        bridge = catalog.stored(relation.through) if relation.through in catalog.entities else catalog.spark.table(relation.through)
        own, others = owners(relation), [f"__other_{i}" for i in range(len(names(relation.through_other)))]
        link = bridge.select(*[F.col(c).alias(o) for c, o in zip(names(relation.through_own), own, strict=True)], *[F.col(c).alias(o) for c, o in zip(names(relation.through_other), others, strict=True)])
        on = [F.col(k) == F.col(o) for k, o in _paired(target, target.key, others)]
        return rows.join(link.distinct(), on).drop(*others), _paired(entity, entity.key, own)
    raise QuillError(f"unknown relation kind {relation.kind!r}")


def names(given: str | tuple[str, ...]) -> list[str]:
    """A key of one column or several."""
    return [given] if isinstance(given, str) else list(given)


def owners(relation) -> list[str]:
    """The columns that hold the owner's key in rows that came through a bridge."""
    own = names(relation.through_own)
    return ["__owner"] if len(own) == 1 else [f"__owner_{i}" for i in range(len(own))]


def _paired(entity: Entity, left, right) -> list[tuple[str, str]]:
    if len(left) != len(right):
        raise QuillError(f"{entity.name}: a relation links {list(left)} with {list(right)}")
    return list(zip(left, right, strict=True))


def page_each_parent(rows: DataFrame, parent: str | list[str], order, take: int | None = None, skip: int = 0) -> DataFrame:
    """``take`` rows of each parent after ``skip``, in a total order; Spark prunes groups before the shuffle."""
    at = Window.partitionBy(*names(parent)).orderBy(*[order_of(o).column for o in order])
    out = rows.withColumn("__rank", F.row_number().over(at))
    out = out.filter(F.col("__rank") > skip) if skip else out
    return (out.filter(F.col("__rank") <= skip + take) if take is not None else out).drop("__rank")


def load_relation(catalog, df: DataFrame, entity: Entity, name: str, options: dict | None = None) -> DataFrame:
    """Add a column ``name``: a struct (null where none) for single relations, an array of structs sorted by key for collections.

    options: where, order, take, skip, relations (nested), with_deleted.
    Children are aggregated before they are joined, so no level multiplies another.
    """
    from quillspark.plans.where import compile_where

    options = options or {}
    relation = entity.relations[name]
    target = catalog.entity(relation.target)
    rows, keys = related(catalog, entity, name, options.get("with_deleted", False))
    other, marks = [o for _, o in keys], [f"__key_{i}" for i in range(len(keys))]
    on = [F.col(own) == F.col(mark) for (own, _), mark in zip(keys, marks, strict=True)]
    marked = [F.col(o).alias(m) for o, m in zip(other, marks, strict=True)]
    if options.get("where") is not None:
        rows = rows.filter(compile_where(options["where"], "", target, catalog, options.get("with_deleted", False)))
    nested = options.get("relations") or {}
    for inner, more in (nested.items() if isinstance(nested, dict) else [(n, None) for n in nested]):
        rows = load_relation(catalog, rows, target, inner, more if isinstance(more, dict) else None)
    fields = [c for c in rows.columns if not c.startswith("__owner")]
    many = relation.kind in ("one_to_many", "many_to_many")
    order = [order_of(o) for o in options.get("order", [])] + [order_of(k) for k in target.key]
    if many and (options.get("take") is not None or options.get("skip")):
        rows = page_each_parent(rows, other, order, options.get("take"), options.get("skip", 0))
    if not many:
        one = rows.select(*marked, F.struct(*fields).alias(name))
        return df.join(one.dropDuplicates(marks) if relation.kind == "one_to_one" and relation.inverse else one, on, "left").drop(*marks)
    place = F.row_number().over(Window.partitionBy(*other).orderBy(*[o.column for o in order]))
    lists = rows.dropna(subset=other).withColumn("__at", place).groupBy(*marked).agg(F.array_sort(F.collect_list(F.struct("__at", F.struct(*fields).alias("row")))).alias("__rows"))
    lists = lists.select(*marks, F.transform("__rows", lambda x: x["row"]).alias(name))
    met = df.join(lists, on, "left").drop(*marks)
    empty = F.array().cast(met.schema[name].dataType)
    return met.withColumn(name, F.coalesce(name, empty))


def with_count(catalog, df: DataFrame, entity: Entity, name: str, alias: str | None = None, where=None) -> DataFrame:
    """Add the number of related rows, 0 where there are none: one grouped count and a left join."""
    from quillspark.plans.where import compile_where

    rows, keys = related(catalog, entity, name)
    if where is not None:
        rows = rows.filter(compile_where(where, "", catalog.entity(entity.relations[name].target), catalog))
    marks = [f"__key_{i}" for i in range(len(keys))]
    counts = rows.groupBy(*[F.col(o).alias(m) for (_, o), m in zip(keys, marks, strict=True)]).agg(F.count("*").alias("__n"))
    label = alias or f"{name}_count"
    on = [F.col(own) == F.col(m) for (own, _), m in zip(keys, marks, strict=True)]
    return df.join(counts, on, "left").withColumn(label, F.coalesce("__n", F.lit(0).cast("bigint"))).drop(*marks, "__n")
