"""Range joins that meet in cells of the axis instead of comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _axis(df: DataFrame, name: str) -> Column:
    """A column as a number on the axis: days of dates, seconds of times."""
    kind = df.select(name).schema[0].dataType.typeName()
    if kind == "date":
        return F.unix_date(F.col(name)).cast("double")
    return F.col(name).cast("timestamp").cast("double") if kind == "timestamp_ntz" else F.col(name).cast("double")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float | None = None, how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Rows of ``left`` with those of ``right`` for which low <= point <= high; how: inner or left.

    Every interval is put into the cells of ``width`` that it covers and every
    point into one, so an equi-join does the work. Without a width it is the
    mean length of the intervals, which a scalar subquery finds; then an
    interval has three copies on average at most. Null points and bounds match
    nothing. ``condition`` is what holds for pairs, the range by default.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join {how!r}")
    start, end = _axis(right, low), _axis(right, high)
    if width is None:
        mean = right.filter(F.col(low) <= F.col(high)).agg(F.avg(end - start)).scalar()
        size = F.when(mean > 0, mean).otherwise(F.lit(1.0))
    else:
        size = F.lit(float(width))
    cell = lambda c: F.floor(c / size).cast("bigint")
    spread = right.filter(F.col(low) <= F.col(high)).withColumn("__cell_r", F.explode(F.sequence(cell(start), cell(end))))
    holds = (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high)) if condition is None else condition
    return left.withColumn("__cell_l", cell(_axis(left, point))).join(spread, (F.col("__cell_l") == F.col("__cell_r")) & holds, how).drop("__cell_l", "__cell_r")
