"""Keyed changes as DataFrame to DataFrame functions. Each returns the table after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.errors import InvalidQuery
from quillspark.functions.expr import column, order_of


def excluded(name: str) -> Column:
    """In an upsert's assignments: the proposed row's value."""
    return F.col(f"__new.{name}")


def one_per_key(rows: DataFrame, keys: list[str], order=None) -> DataFrame:
    """Of proposed rows that share a key, the first in the order (by all columns where none is given)."""
    at = Window.partitionBy(*keys).orderBy(*[order_of(o).column for o in order or rows.columns])
    return rows.withColumn("__n", F.row_number().over(at)).filter("__n = 1").drop("__n")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    return table.unionByName(one_per_key(rows, keys).join(table, keys, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], assign: list[str] | dict | None = None, where: Column | None = None) -> DataFrame:
    """ON CONFLICT DO UPDATE by one full join.

    assign: columns taken from the proposed row (all but the keys by default),
    or {column: expression} over ``__old`` and ``__new``; nothing to assign
    means DO NOTHING. Where ``where`` does not hold, the old row stays.
    """
    if assign is None:
        assign = [c for c in rows.columns if c not in keys]
    sets = {c: excluded(c) for c in assign} if isinstance(assign, list) else {c: column(v) for c, v in assign.items()}
    if not sets:
        return insert_ignore(table, rows, keys)
    new = one_per_key(rows, keys).withColumn("__is_new", F.lit(True)).alias("__new")
    old = table.withColumn("__is_old", F.lit(True)).alias("__old")
    on = F.lit(True)
    for i, k in enumerate(keys):
        same = F.col(f"__old.{k}") == F.col(f"__new.{k}")
        on = same if i == 0 else on & same
    both = F.col("__is_old").isNotNull() & F.col("__is_new").isNotNull()
    change = both if where is None else both & F.coalesce(column(where), F.lit(False))
    out = []
    for c in table.columns:
        proposed = F.col(f"__new.{c}") if c in rows.columns else F.lit(None)
        kept = F.when(change, sets[c]).otherwise(F.col(f"__old.{c}")) if c in sets else F.col(f"__old.{c}")
        out.append(F.when(F.col("__is_old").isNull(), proposed).otherwise(kept).cast(table.schema[c].dataType).alias(c))
    return old.join(new, on, "full").select(*out)


def update(table: DataFrame, where, assign: dict, order=None, limit: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """SET columns where the condition holds; with ``limit``, in the first rows of the order (``keys`` tell rows apart)."""
    c = F.coalesce(column(where), F.lit(False))
    if limit is not None:
        if not keys:
            raise InvalidQuery("a limited update needs keys")
        chosen = table.filter(c).orderBy(*[order_of(o).column for o in [*(order or []), *keys]]).limit(limit).select(*keys, F.lit(True).alias("__hit"))
        table = table.join(F.broadcast(chosen) if limit <= 100_000 else chosen, keys, "left")
        c = F.col("__hit").isNotNull()
    out = [F.when(c, column(assign[n])).otherwise(F.col(n)).cast(table.schema[n].dataType).alias(n) if n in assign else F.col(n) for n in table.columns if n != "__hit"]
    return table.select(*out)


def delete(table: DataFrame, where) -> DataFrame:
    """Rows for which the condition holds go; a null condition does not hold."""
    if where is None:
        raise InvalidQuery("delete needs a condition; use clear() to delete all rows")
    return table.filter(~F.coalesce(column(where), F.lit(False)))


def delete_keys(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(rows, keys, "left_anti")


def soft_delete(table: DataFrame, where, name: str, at: Column | None = None) -> DataFrame:
    if where is None:
        raise InvalidQuery("soft delete needs a condition")
    return update(table, column(where) & F.col(name).isNull(), {name: at if at is not None else F.current_timestamp()})


def restore(table: DataFrame, where, name: str) -> DataFrame:
    return update(table, where, {name: F.lit(None)})


def attach(bridge: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of a many-to-many bridge, each once."""
    return bridge.unionByName(links.distinct().join(bridge, bridge.columns, "left_anti"))


def detach(bridge: DataFrame, links: DataFrame) -> DataFrame:
    return bridge.join(links, links.columns, "left_anti")
