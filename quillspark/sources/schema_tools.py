"""Table definitions, differences between schemas, and ordered scripts with a history."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.entity import Entity
from quillspark.sources.store import Snapshots


def create_table(entity: Entity, partitioned_by: list[str] | None = None) -> str:
    """CREATE TABLE over Parquet. Keys and uniqueness are checked by the write layer, not by the table."""
    rows = ", ".join(f"`{c.name or p}` {c.spark_type()}" + ("" if c.nullable and not c.primary else " NOT NULL") for p, c in entity.stored.items())
    return f"CREATE TABLE IF NOT EXISTS {entity.table} ({rows}) USING parquet" + (f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else "")


@dataclass
class Difference:
    added: dict[str, str]
    removed: list[str]
    changed: dict[str, tuple[str, str]]
    renamed: dict[str, str]


def diff(old: T.StructType, new: T.StructType) -> Difference:
    """A removed and an added column of one type and a like name are a rename."""
    a, b = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (old, new))
    added, removed = {n: t for n, t in b.items() if n not in a}, [n for n in a if n not in b]
    renamed = {}
    for n in list(removed):
        close = difflib.get_close_matches(n, [m for m, t in added.items() if t == a[n]], 1, 0.5)
        if close:
            renamed[n] = close[0]
            removed.remove(n)
            added.pop(close[0])
    return Difference(added, removed, {n: (a[n], b[n]) for n in a if n in b and a[n] != b[n]}, renamed)


def conform(df: DataFrame, change: Difference, new: T.StructType) -> DataFrame:
    """Rows of the old schema under the new one: renamed, cast, and null where new."""
    back = {v: k for k, v in change.renamed.items()}
    pick = lambda f: F.lit(None) if f.name in change.added else F.col(f"`{back.get(f.name, f.name)}`")
    return df.select(*[pick(f).cast(f.dataType).alias(f.name) for f in new.fields])


def synchronize(store: Snapshots, entity: Entity, allow_loss: bool = False, dry_run: bool = False) -> Difference:
    """Bring a stored table to the entity's schema. Columns are dropped only with ``allow_loss``."""
    current = store.read()
    change = diff(current.schema, entity.schema())
    if change.removed and not allow_loss:
        raise ValueError(f"columns {change.removed} would be lost")
    if not dry_run and (change.added or change.removed or change.changed or change.renamed):
        target = Snapshots(store.spark, store.path, entity.schema())
        target.write(conform(current, change, entity.schema()), store.current())
    return change


class Runner:
    """Scripts (name, up, down or None) in order, each once; the history is a table. Migrations and seeds both run so."""

    def __init__(self, spark: SparkSession, path: str, scripts: list[tuple[str, Callable, Callable | None]]):
        self.spark, self.scripts = spark, scripts
        self.history = Snapshots(spark, path, T.StructType.fromDDL("name string, position int, at timestamp"))

    def executed(self) -> list[str]:
        return [r.name for r in self.history.read().orderBy("position").collect()]

    def pending(self) -> list[str]:
        done = set(self.executed())
        return [n for n, _, _ in self.scripts if n not in done]

    def status(self) -> dict[str, bool]:
        done = set(self.executed())
        return {n: n in done for n, _, _ in self.scripts}

    def run(self) -> list[str]:
        names = self.pending()
        for name, up, _ in self.scripts:
            if name in names:
                up()
                row = self.spark.createDataFrame([(name, len(self.executed()))], "name string, position int").withColumn("at", F.current_timestamp())
                self.history.append(row)
        return names

    run_all = run

    def revert_last(self) -> str | None:
        done = self.executed()
        if not done:
            return None
        down = next((d for n, _, d in self.scripts if n == done[-1]), None)
        if down is not None:
            down()
        self.history.write(self.history.read().filter(F.col("name") != done[-1]), self.history.current())
        return done[-1]
