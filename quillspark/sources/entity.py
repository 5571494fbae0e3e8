"""Entity definitions: columns, keys, relations, inheritance and managed columns."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import QuillError, UnknownColumn

#: Type names of definitions and their Spark types.
TYPES = {
    "int": "int", "smallint": "smallint", "tinyint": "tinyint", "bigint": "bigint", "float": "float", "real": "float", "double": "double", "decimal": "decimal(18,4)", "numeric": "decimal(18,4)",
    "boolean": "boolean", "varchar": "string", "char": "string", "text": "string", "longtext": "string", "uuid": "string", "enum": "string", "json": "string", "jsonb": "string",
    "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "date": "date", "blob": "binary",
}


@dataclass(frozen=True)
class Codec:
    """How values are stored: ``to`` and ``back`` map columns. Filter operands pass through ``to``, results through ``back``."""

    to: Callable[[SparkColumn], SparkColumn]
    back: Callable[[SparkColumn], SparkColumn]


class TypeRegistry:
    """Named column types of an application: a Spark type and, if need be, a codec."""

    def __init__(self):
        self.own: dict[str, tuple[str, Codec | None]] = {}

    def register(self, name: str, spark_type: str, codec: Codec | None = None) -> None:
        if name in TYPES or name in self.own:
            raise QuillError(f"type {name!r} exists")
        self.own[name] = spark_type, codec

    def resolve(self, name: str) -> tuple[str, Codec | None]:
        if name in self.own:
            return self.own[name]
        if name.startswith("array<"):
            return f"array<{self.resolve(name[6:-1])[0]}>", None
        base = name.split("(")[0]
        if base in ("decimal", "numeric") and "(" in name:
            return "decimal" + name[len(base) :], None
        if base not in TYPES:
            raise QuillError(f"unknown type {name!r}")
        return TYPES[base], None


registry = TypeRegistry()


@dataclass(frozen=True)
class Column:
    """A column of an entity. ``name``: in storage, where it differs; ``compute``: an expression over the others, not stored."""

    type: str = "text"
    name: str | None = None
    primary: bool = False
    nullable: bool = True
    generated: str | None = None  # increment, uuid
    codec: Codec | None = None
    compute: Callable | str | None = None
    role: str | None = None  # deleted_at, created_at, updated_at, version, tenant
    checks: tuple = ()

    def spark_type(self) -> str:
        return registry.resolve(self.type)[0]


@dataclass(frozen=True)
class Relation:
    """kind: many_to_one, one_to_many, one_to_one, many_to_many. ``key``: the foreign key property on the owning side.

    Keys of several columns are tuples, in the order of the key they refer to.
    """

    kind: str
    target: str
    key: str | tuple[str, ...] | None = None
    through: str | None = None
    through_own: str | tuple[str, ...] | None = None
    through_other: str | tuple[str, ...] | None = None
    eager: bool = False
    cascade: bool = False
    inverse: bool = False


@dataclass(frozen=True)
class Inheritance:
    """strategy: single (one table), joined (a table each, sharing the key), concrete (a full table each)."""

    strategy: str
    parent: str | None = None
    value: str | None = None
    discriminator: str = "dtype"


@dataclass(frozen=True)
class Entity:
    name: str
    table: str
    columns: dict[str, Column]
    relations: dict[str, Relation] = field(default_factory=dict)
    inheritance: Inheritance | None = None
    scopes: dict[str, Callable] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    #: The files of written tables are sorted by the first index, so that Parquet's minima and maxima prune by its columns.
    indexes: tuple[tuple[str, ...], ...] = ()

    @property
    def key(self) -> list[str]:
        return [p for p, c in self.columns.items() if c.primary]

    @property
    def stored(self) -> dict[str, Column]:
        return {p: c for p, c in self.columns.items() if c.compute is None}

    def role(self, role: str) -> str | None:
        return next((p for p, c in self.columns.items() if c.role == role), None)

    def storage_name(self, prop: str) -> str:
        return self.columns[prop].name or prop

    def check(self, names) -> None:
        """Unknown names are an error that proposes a known one."""
        for n in names:
            if n not in self.columns and n not in self.relations:
                close = difflib.get_close_matches(n, [*self.columns, *self.relations], 1)
                raise UnknownColumn(f"{self.name} has no {n!r}" + (f"; did you mean {close[0]!r}?" if close else ""))

    def read(self, stored: DataFrame) -> DataFrame:
        """Storage columns under their property names, codecs undone, computed columns added."""
        out = []
        for p, c in self.stored.items():
            value = F.col(f"`{c.name or p}`")
            codec = c.codec or registry.resolve(c.type)[1]
            out.append((codec.back(value) if codec else value).alias(p))
        df = stored.select(*out)
        for p, c in self.columns.items():
            if c.compute is not None:
                made = F.expr(c.compute) if isinstance(c.compute, str) else c.compute(df)
                df = df.withColumn(p, made if isinstance(made, SparkColumn) else made.column)
        return df

    def write(self, frame: DataFrame) -> DataFrame:
        """Property columns under their storage names, codecs applied, cast to the declared types."""
        out = []
        for p, c in self.stored.items():
            value = F.col(f"`{p}`")
            codec = c.codec or registry.resolve(c.type)[1]
            out.append((codec.to(value) if codec else value.cast(c.spark_type())).alias(c.name or p))
        return frame.select(*out)

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{c.name or p}` {c.spark_type()}" for p, c in self.stored.items()))


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def define_entity(name: str, columns: dict[str, Column], table: str | None = None, naming: Callable[[str], str] | None = None, **more) -> Entity:
    """An entity. ``naming`` maps properties without a name of their own to storage names."""
    if naming:
        columns = {p: c if c.name or c.compute else replace(c, name=naming(p)) for p, c in columns.items()}
    return Entity(name, table or snake_case(name), columns, **more)
