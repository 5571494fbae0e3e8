"""The catalog: entities bound to tables, and the scopes that every read of them carries."""

from __future__ import annotations

import contextlib
import contextvars
from collections import ChainMap
from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import QuillError, TenantError
from quillspark.sources.entity import Column, Entity, Relation, define_entity

_tenant: contextvars.ContextVar = contextvars.ContextVar("tenant", default=None)


@contextlib.contextmanager
def tenant(value) -> Iterator[None]:
    """Reads and writes inside carry this tenant."""
    token = _tenant.set(value)
    try:
        yield
    finally:
        _tenant.reset(token)


def current_tenant():
    return _tenant.get()


_primary: contextvars.ContextVar = contextvars.ContextVar("primary", default=False)


@contextlib.contextmanager
def use_master() -> Iterator[None]:
    """Reads inside take the first place of replicated entities."""
    token = _primary.set(True)
    try:
        yield
    finally:
        _primary.reset(token)


class Replicated:
    """A source with replicas: reads go round the replicas, or to the source itself inside use_master()."""

    def __init__(self, source, replicas: tuple):
        self.source, self.replicas, self.turn = source, tuple(replicas), 0

    def next(self):
        if _primary.get():
            return self.source
        self.turn += 1
        return self.replicas[(self.turn - 1) % len(self.replicas)]


class Catalog:
    """Entities by name, each with a source: a path, a table name, a function of the session, or a DataFrame.

    ``layer()`` gives a catalog on top of this one, whose entities hide those below.
    """

    def __init__(self, spark: SparkSession, strict_tenants: bool = False, _maps: ChainMap | None = None):
        self.spark, self.strict = spark, strict_tenants
        self.entities: ChainMap[str, tuple[Entity, object]] = _maps if _maps is not None else ChainMap()

    def layer(self) -> Catalog:
        return Catalog(self.spark, self.strict, self.entities.new_child())

    def register(self, entity: Entity, source: str | Callable[[SparkSession], DataFrame] | DataFrame | None = None, replicas: tuple = ()) -> Entity:
        """``replicas``: further places with the same rows, which reads take in turn (see Replicated)."""
        source = source if source is not None else entity.table
        self.entities[entity.name] = entity, Replicated(source, replicas) if replicas else source
        return entity

    def entity(self, name: str | Entity) -> Entity:
        if isinstance(name, Entity):
            return name
        if name not in self.entities:
            raise QuillError(f"no entity {name!r}")
        return self.entities[name][0]

    def stored(self, name: str | Entity) -> DataFrame:
        """The table as it is stored."""
        source = self.entities[self.entity(name).name][1]
        if isinstance(source, Replicated):
            source = source.next()
        if isinstance(source, DataFrame):
            return source
        if callable(source):
            return source(self.spark)
        if hasattr(source, "read"):
            return source.read()
        return self.spark.read.parquet(source) if "/" in source else self.spark.table(source)

    def children(self, entity: Entity) -> list[Entity]:
        return [e for e, _ in self.entities.values() if e.inheritance and e.inheritance.parent == entity.name]

    def scan(self, name: str | Entity, with_deleted: bool = False, tenant_scope: bool = True) -> DataFrame:
        """Rows of an entity under its property names, with inheritance, soft delete and tenant scope at the scan."""
        from quillspark.operators.inheritance import scan_rows

        entity = self.entity(name)
        df = scan_rows(self, entity)
        deleted = entity.role("deleted_at")
        if deleted and not with_deleted:
            df = df.filter(F.col(deleted).isNull())
        owner = entity.role("tenant")
        if owner and tenant_scope:
            value = current_tenant()
            if value is not None:
                df = df.filter(F.col(owner) == F.lit(value))
            elif self.strict:
                raise TenantError(f"{entity.name} is read without a tenant")
        return df


def introspect(df: DataFrame, name: str, key: list[str] | None = None) -> Entity:
    """An entity from the schema of a table."""
    back = {"int": "int", "bigint": "bigint", "smallint": "smallint", "tinyint": "tinyint", "float": "float", "double": "double", "boolean": "boolean", "string": "text", "timestamp_ntz": "datetime", "timestamp": "timestamptz", "date": "date", "binary": "blob"}
    kind = lambda t: f"array<{kind(t[6:-1])}>" if t.startswith("array<") else back.get(t, t if t.startswith("decimal") else "json")
    return define_entity(name, {f.name: Column(kind(f.dataType.simpleString()), primary=f.name in (key or []), nullable=f.nullable) for f in df.schema.fields})


def source_code(entity: Entity) -> str:
    """Python source that defines the entity."""
    rows = ",\n".join(f"    {p!r}: Column({c.type!r}{', primary=True' if c.primary else ''}{'' if c.nullable else ', nullable=False'}{f', name={c.name!r}' if c.name else ''})" for p, c in entity.columns.items())
    return f"{entity.name} = define_entity({entity.name!r}, {{\n{rows},\n}}, table={entity.table!r})\n"


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def list_schemas(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases())


def describe_table(spark: SparkSession, table: str) -> list[dict]:
    return [{"name": c.name, "type": c.dataType, "nullable": c.nullable} for c in spark.catalog.listColumns(table)]


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table of another database, read in ranges of ``key`` where bounds are given. The driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def jdbc_write(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, **options: str) -> None:
    """Rows into a table of another database, a connection for each partition. mode: append, overwrite, ignore or error."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode(mode).save()


def jdbc_entity(spark: SparkSession, url: str, table: str, schema: str | None = None, **options: str) -> Entity:
    """An entity from the catalog of another database: columns, primary key, and a many_to_one relation for each foreign key."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        found = connection.getMetaData()
        key = [name for _, name in sorted(_rows(found.getPrimaryKeys(None, schema, table), ("KEY_SEQ", "COLUMN_NAME")))]
        foreign: dict[str, list] = {}
        for constraint, at, own, target in _rows(found.getImportedKeys(None, schema, table), ("FK_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKTABLE_NAME")):
            foreign.setdefault(constraint, []).append((at, own, target))
    finally:
        connection.close()
    entity = introspect(jdbc(spark, url, f"{schema}.{table}" if schema else table, **options), table, key)
    links = {}
    for parts in foreign.values():
        own = tuple(name for _, name, _ in sorted(parts))
        links[parts[0][2].lower()] = Relation("many_to_one", parts[0][2], own[0] if len(own) == 1 else own)
    return replace(entity, relations=links)


def _rows(result, names: tuple[str, ...]) -> list[tuple]:
    out = []
    while result.next():
        out.append(tuple(int(result.getInt(n)) if n == "KEY_SEQ" else result.getString(n) for n in names))
    return out


def tenant_source(place: str) -> Callable[[SparkSession], DataFrame]:
    """A schema, a table or a folder of its own for each tenant: ``place`` holds ``{tenant}``. A read without a tenant is an error."""

    def read(spark: SparkSession) -> DataFrame:
        value = current_tenant()
        if value is None:
            raise TenantError(f"{place} is read without a tenant")
        where = place.format(tenant=value)
        return spark.read.parquet(where) if "/" in where else spark.table(where)

    return read
