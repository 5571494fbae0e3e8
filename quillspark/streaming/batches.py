"""Batched iteration over results, and event-time aggregates over streams."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.expr import as_expr


def batched_rows(df: DataFrame, size: int) -> Iterator[list[dict]]:
    """Lists of ``size`` rows, one partition at a time on the driver."""
    if size < 1:
        raise ValueError("a batch has one row at least")
    rows = (r.asDict(recursive=True) for r in df.toLocalIterator(prefetchPartitions=True))
    while batch := list(itertools.islice(rows, size)):
        yield batch


def _stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder that driver and executors share, and read it back."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = f"{root.rstrip('/')}/batches-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with each row's place in the order, from 0. Rows are sorted once, in ranges; the driver gets one count a range."""
    kept = _stored(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))
    share = F.shiftright(name, 33)  # the id: the number of the range, then 33 bits for the place in it
    counts = sorted(kept.groupBy(share.alias("share")).count().collect())
    before = itertools.accumulate((n for _, n in counts), initial=0)
    starts = df.sparkSession.createDataFrame([(k, b - (k << 33)) for (k, _), b in zip(counts, before)], "__share long, __start long")
    met = kept.join(F.broadcast(starts), share == F.col("__share"))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(name) + F.col("__start")).alias(name))


class Pipeline:
    """A scan whose rows skip entities: filters and mappings stay distributed, terminals bring rows or Arrow batches."""

    def __init__(self, df: DataFrame):
        self.df = df

    def where(self, condition) -> Pipeline:
        from quillspark.plans.where import compile_where

        return Pipeline(self.df.filter(compile_where(condition)))

    def filter(self, test) -> Pipeline:
        """A column condition, or a function of a row dictionary that runs in Arrow batches on the executors."""
        if not callable(test):
            return self.where(test)
        keep = lambda batches: (b.filter(pa.array([bool(test(r)) for r in b.to_pylist()], pa.bool_())) for b in batches)
        return Pipeline(self.df.mapInArrow(keep, self.df.schema))

    def map(self, f: Callable[[dict], dict] | list, schema: str | None = None) -> Pipeline:
        """Columns to select, or a function of a row dictionary with the schema of what it returns."""
        if not callable(f):
            return Pipeline(self.df.select(*[as_expr(c).column for c in f]))
        target = self.df.sparkSession.createDataFrame([], schema).schema
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        run = lambda batches: (pa.RecordBatch.from_pylist([f(r) for r in b.to_pylist()], schema=arrow) for b in batches)
        return Pipeline(self.df.mapInArrow(run, schema))

    def raw(self, size: int = 1000) -> Iterator[list[dict]]:
        return batched_rows(self.df, size)

    def binary(self) -> pa.Table:
        return self.df.toArrow()

    array_mode = binary

    def collect(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.df.collect()]

    def count(self) -> int:
        return self.df.count()

    @staticmethod
    def _keyset(order: str, key: str) -> list[Column]:
        return [F.col(order).asc_nulls_last(), F.col(key).asc_nulls_last()]

    def keyset_batches(self, order: str, key: str, size: int = 1000) -> Iterator[list[dict]]:
        """Pages by (order, key), nulls last. Rows are sorted once and come to the driver one partition at a time."""
        return batched_rows(self.df.orderBy(*self._keyset(order, key)), size)

    def offset_batches(self, order: list[str], size: int = 1000) -> Iterator[list[dict]]:
        """The pages that LIMIT and OFFSET give, from one sort."""
        return batched_rows(self.df.orderBy(*order), size)

    def keyset_map(self, order: str, key: str, f: Callable[[list[dict]], list[dict]], schema: str, size: int = 1000) -> Pipeline:
        """What f makes of each page of keyset_batches. It runs on the executors, so no page comes to the driver."""
        return self._map_pages(self._keyset(order, key), f, schema, size)

    def offset_map(self, order: list[str], f: Callable[[list[dict]], list[dict]], schema: str, size: int = 1000) -> Pipeline:
        """What f makes of each page of offset_batches. It runs on the executors, so no page comes to the driver."""
        return self._map_pages(order, f, schema, size)

    def _map_pages(self, order: list[str | Column], f: Callable[[list[dict]], list[dict]], schema: str, size: int) -> Pipeline:
        if size < 1:
            raise ValueError("a batch has one row at least")
        place = "__place"
        while place in self.df.columns:
            place = "_" + place
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.df.sparkSession.createDataFrame([], schema).schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            page, rows = None, []
            for b in batches:
                made = []
                at = [x // size for x in b.column(b.num_columns - 1).to_pylist()]
                for n, r in zip(at, b.drop_columns([place]).to_pylist()):
                    if n != page:
                        made += f(rows) if rows else []
                        page, rows = n, []
                    rows.append(r)
                yield pa.RecordBatch.from_pylist(made, schema=arrow)
            if rows:
                yield pa.RecordBatch.from_pylist(f(rows), schema=arrow)

        dealt = numbered(self.df, order, place).repartition(F.expr(f"{place} div {size}")).sortWithinPartitions(place)
        return Pipeline(dealt.mapInArrow(run, schema))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows for each key and tumbling window; on a stream, windows close ``late`` after their end."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
