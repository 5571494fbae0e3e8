"""EntityManager: reads by options, keyed writes, units of work, caches, events and plugins over one catalog."""

from __future__ import annotations

import contextlib
import functools
import time
import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import EntityNotFound, InvalidQuery, OptimisticLockError, QuillError, TenantError, ValidationError
from quillspark.functions.expr import column
from quillspark.operators import write
from quillspark.plans.query import SelectQuery
from quillspark.plans.raw import RawQuery
from quillspark.plans.where import compile_where
from quillspark.sources.catalog import Catalog, current_tenant, tenant, use_master
from quillspark.sources.entity import Entity, Relation
from quillspark.sources.store import Memory, Snapshots
from quillspark.streaming.batches import Pipeline, batched_rows

OPTIONS = {"where", "select", "order", "take", "skip", "relations", "with_count", "with_deleted", "group_by", "having", "distinct", "without_tenant", "lock", "use_master"}


class Events:
    """Named callbacks; subscribers are objects whose methods bear the events' names."""

    def __init__(self):
        self.calls: dict[str, list[Callable]] = defaultdict(list)

    def on(self, name: str, call: Callable) -> None:
        self.calls[name].append(call)

    def off(self, name: str, call: Callable) -> None:
        self.calls[name].remove(call)

    def subscribe(self, subscriber: object) -> None:
        for name in ("after_load", "before_insert", "after_insert", "before_update", "after_update", "before_delete", "after_delete", "before_query", "after_query"):
            if hasattr(subscriber, name):
                self.on(name, getattr(subscriber, name))

    def emit(self, name: str, *args) -> None:
        for call in self.calls[name]:
            call(*args)


@dataclass
class Tracker:
    """Times of actions; slow ones apart, and how often the same read ran."""

    slow: float = 1.0
    log: list[tuple[str, float]] = field(default_factory=list)

    @contextlib.contextmanager
    def timed(self, what: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.log.append((what, time.monotonic() - began))

    def slow_ones(self) -> list[tuple[str, float]]:
        return [x for x in self.log if x[1] >= self.slow]

    def repeated(self, least: int = 5) -> dict[str, int]:
        """Reads that ran so often: signs of a loop where one join would do."""
        counts: dict[str, int] = defaultdict(int)
        for what, _ in self.log:
            counts[what] += 1
        return {k: n for k, n in counts.items() if n >= least}


class ResultCache:
    """Cached DataFrames by key, with an age limit, a number limit and tags; a write drops what bears its table's tag."""

    def __init__(self, most: int = 100):
        self.most = most
        self.kept: OrderedDict[str, tuple[float, set[str], DataFrame]] = OrderedDict()

    def frame(self, key: str, tags: set[str], ttl: float, make: Callable[[], DataFrame]) -> DataFrame:
        now = time.monotonic()
        if key in self.kept and self.kept[key][0] > now:
            self.kept.move_to_end(key)
            return self.kept[key][2]
        self._drop(key)
        df = make().cache()
        self.kept[key] = now + ttl, tags, df
        while len(self.kept) > self.most:
            self._drop(next(iter(self.kept)))
        return df

    def _drop(self, key: str) -> None:
        if key in self.kept:
            self.kept.pop(key)[2].unpersist()

    def invalidate(self, *tags: str) -> None:
        for key in [k for k, (_, own, _) in self.kept.items() if own & set(tags)]:
            self._drop(key)

    def clear(self) -> None:
        for key in list(self.kept):
            self._drop(key)


class EntityManager:
    def __init__(self, spark: SparkSession, root: str | None = None, strict_tenants: bool = False, in_memory: bool = False):
        self.spark, self.root, self.in_memory = spark, root, in_memory
        self.catalog = Catalog(spark, strict_tenants)
        self.events, self.tracker, self.cache, self.plugins = Events(), Tracker(), ResultCache(), {}

    # set-up
    def register(self, entity: Entity, source=None) -> Entity:
        """Bind an entity to a source; without one, to a writable table under the manager's root, or in memory."""
        if source is None and self.in_memory:
            source = Memory(self.spark, entity.schema())
        if source is None:
            if self.root is None:
                raise QuillError("a manager without root needs a source")
            sort = tuple(entity.storage_name(p) for p in entity.indexes[0]) if entity.indexes else ()
            source = Snapshots(self.spark, f"{self.root}/{entity.table}", entity.schema(), sort)
        return self.catalog.register(entity, source)

    def extend(self, plugin) -> Any:
        """A plugin has a name, and may have install(manager) and the methods of a subscriber."""
        if plugin.name in self.plugins:
            return self.plugins[plugin.name]
        self.plugins[plugin.name] = plugin
        self.events.subscribe(plugin)
        if hasattr(plugin, "install"):
            plugin.install(self)
        return plugin

    def has_plugin(self, name: str) -> bool:
        return name in self.plugins

    def repository(self, name: str) -> Repository:
        return Repository(self, self.catalog.entity(name))

    # reads
    def create_query_builder(self, name: str | None = None, alias: str | None = None):
        """A typed builder over an entity, or a raw one."""
        if name is None:
            return RawQuery(self.spark)
        entity = self.catalog.entity(name)
        label = alias or entity.name
        return SelectQuery(self.catalog, entity, self.catalog.scan(entity).alias(label), label)

    def query(self, text: str, shape=None, **args) -> DataFrame:
        """Raw SQL with named parameters; ``shape``, a StructType, is what the rows must fit."""
        df = self.spark.sql(text, args=args) if args else self.spark.sql(text)
        return df if shape is None else read_shape(df, shape)

    def find_df(self, name: str, **options) -> DataFrame:
        """The lazy DataFrame behind find(): scope, filter, relations, group, order and page in one plan."""
        unknown = set(options) - OPTIONS
        if unknown:
            raise InvalidQuery(f"unknown options {sorted(unknown)}")
        entity = self.catalog.entity(name)
        if options.get("use_master"):
            with use_master():
                return self.find_df(name, **{k: v for k, v in options.items() if k != "use_master"})
        q = SelectQuery(self.catalog, entity, self.catalog.scan(entity, options.get("with_deleted", False), not options.get("without_tenant", False)).alias(entity.name), entity.name)
        if options.get("where") is not None:
            q = replace(q, scope_={"with_deleted": bool(options.get("with_deleted", False))}).where(options["where"])
        names = list(options.get("select") or [])
        entity.check(names)
        relations = options.get("relations") or {}
        for r, more in relations.items() if isinstance(relations, dict) else [(r, {}) for r in relations]:
            q = q.load_relation(r, **(more if isinstance(more, dict) else {}))
        eager = [r for r, x in entity.relations.items() if x.eager and r not in relations]
        for r in eager:
            q = q.load_relation(r)
        counts = options.get("with_count") or []
        for r in counts:
            q = q.with_count(r)
        if options.get("group_by"):
            entity.check(options["group_by"])
            q = q.group_by(*options["group_by"])
            if options.get("having") is not None:
                q = q.having(options["having"])
        if names:
            q = q.select(*names, *relations, *eager, *[f"{r}_count" for r in counts])
        if options.get("distinct"):
            q = q.distinct()
        order = options.get("order") or []
        q = q.order_by(*(order.items() if isinstance(order, dict) else order)) if order else q
        q = q.offset(options["skip"]) if options.get("skip") else q
        return (q.limit(options["take"]) if options.get("take") is not None else q).to_df()

    def _rows(self, name: str, df: DataFrame) -> list[dict]:
        self.events.emit("before_query", name)
        with self.tracker.timed(f"find {name}"):
            rows = [r.asDict(recursive=True) for r in df.collect()]
        self.events.emit("after_query", name, rows)
        for r in rows:
            self.events.emit("after_load", name, r)
        return rows

    def find(self, name: str, **options) -> list[dict]:
        ttl = options.pop("cache", None)
        if ttl:
            df = self.cache.frame(f"{name}:{current_tenant()!r}:{sorted(options.items(), key=lambda x: x[0])!r}", {self.catalog.entity(name).table}, ttl, lambda: self.find_df(name, **options))
            return self._rows(name, df)
        return self._rows(name, self.find_df(name, **options))

    def find_by(self, name: str, where: dict) -> list[dict]:
        return self.find(name, where=where)

    def find_one(self, name: str, **options) -> dict | None:
        rows = self.find(name, **options | {"take": 1})
        return rows[0] if rows else None

    def find_one_by(self, name: str, where: dict) -> dict | None:
        return self.find_one(name, where=where)

    def find_one_or_fail(self, name: str, **options) -> dict:
        row = self.find_one(name, **options)
        if row is None:
            raise EntityNotFound(name)
        return row

    def find_one_by_or_fail(self, name: str, where: dict) -> dict:
        return self.find_one_or_fail(name, where=where)

    def _key(self, entity: Entity, value) -> dict:
        value = value if isinstance(value, dict) else {entity.key[0]: value} if len(entity.key) == 1 else None
        if value is None or set(value) != set(entity.key) or any(v is None for v in value.values()):
            raise InvalidQuery(f"{entity.name} needs a value for each of {entity.key}")
        return value

    def find_by_pk(self, name: str, key) -> dict | None:
        return self.find_one(name, where=self._key(self.catalog.entity(name), key))

    def find_by_pks(self, name: str, keys: list) -> list[dict]:
        """No key, no query; one key column becomes an IN list, several a semi join with the keys."""
        entity = self.catalog.entity(name)
        if not keys:
            return []
        if len(entity.key) == 1:
            return self.find(name, where={entity.key[0]: list(keys)})
        wanted = self.spark.createDataFrame([tuple(self._key(entity, k)[p] for p in entity.key) for k in keys], ", ".join(f"`{p}` {entity.columns[p].spark_type()}" for p in entity.key))
        return self._rows(name, self.catalog.scan(entity).join(wanted.distinct(), entity.key, "left_semi"))

    def find_by_pks_map(self, name: str, keys: list) -> dict:
        entity = self.catalog.entity(name)
        return {r[entity.key[0]]: r for r in self.find_by_pks(name, keys)}

    def find_and_count(self, name: str, **options) -> tuple[list[dict], int]:
        whole = {k: v for k, v in options.items() if k not in ("take", "skip", "order", "relations", "with_count")}
        return self.find(name, **options), self.find_df(name, **whole).count()

    def find_with_page(self, name: str, page: int = 1, page_size: int = 20, **options):
        q = self.create_query_builder(name)
        q = q.where(options["where"]) if options.get("where") is not None else q
        return q.order_by(*(options.get("order") or self.catalog.entity(name).key)).paginate(page, page_size)

    def find_with_cursor(self, name: str, take: int = 20, cursor: str | None = None, **options):
        q = self.create_query_builder(name)
        q = q.where(options["where"]) if options.get("where") is not None else q
        return q.order_by(*(options.get("order") or self.catalog.entity(name).key)).get_cursor(take, cursor)

    def pluck(self, name: str, prop: str, **options) -> list:
        return [r[0] for r in self.find_df(name, **options).select(prop).collect()]

    def stream(self, name: str, **options) -> Iterator[dict]:
        for batch in self.stream_batch(name, 1000, **options):
            yield from batch

    def stream_batch(self, name: str, size: int = 1000, **options) -> Iterator[list[dict]]:
        yield from batched_rows(self.find_df(name, **options), size)

    def pipe(self, name: str, **options) -> Pipeline:
        return Pipeline(self.find_df(name, **options))

    def explain(self, name: str, **options) -> str:
        return SelectQuery(self.catalog, None, self.find_df(name, **options)).explain()

    def exists(self, name: str, where=None) -> bool:
        return not self.find_df(name, where=where).limit(1).isEmpty()

    def count(self, name: str, where=None) -> int:
        return self.find_df(name, where=where).count()

    def _aggregate(self, fn: str, name: str, prop: str, where=None):
        self.catalog.entity(name).check([prop])
        found = self.find_df(name, where=where).agg(getattr(F, fn)(prop)).head()[0]
        return 0 if found is None else found

    def sum(self, name: str, prop: str, where=None):
        return self._aggregate("sum", name, prop, where)

    def avg(self, name: str, prop: str, where=None):
        return self._aggregate("avg", name, prop, where)

    def min(self, name: str, prop: str, where=None):
        return self._aggregate("min", name, prop, where)

    def max(self, name: str, prop: str, where=None):
        return self._aggregate("max", name, prop, where)

    # writes
    def _store(self, entity: Entity) -> Snapshots | Memory:
        store = self.catalog.entities[entity.name][1]
        if not isinstance(store, (Snapshots, Memory)):
            raise QuillError(f"{entity.name} is not writable")
        return store

    def _table(self, entity: Entity) -> tuple[DataFrame, str | None]:
        """All stored rows under property names, and the version they are of."""
        store = self._store(entity)
        return entity.read(store.read()).select(*entity.stored), store.current()

    def _commit(self, entity: Entity, df: DataFrame, version: str | None) -> None:
        self._store(entity).write(entity.write(df), version)
        self.cache.invalidate(entity.table)

    def create(self, name: str, **values) -> dict:
        """A row of the entity, not yet written."""
        entity = self.catalog.entity(name)
        entity.check(values)
        return {p: values.get(p) for p in entity.stored}

    def merge(self, row: dict, **values) -> dict:
        return row | values

    def preload(self, name: str, **values) -> dict | None:
        entity = self.catalog.entity(name)
        row = self.find_by_pk(name, {k: values[k] for k in entity.key})
        return None if row is None else row | values

    def _prepared(self, entity: Entity, rows: list[dict], fresh: bool) -> list[dict]:
        """Keys, managed columns, tenant and checks, before rows are written."""
        out = []
        following = None
        for given in rows:
            entity.check(given)
            r = {p: v for p, v in given.items() if p in entity.stored}
            for p, c in entity.stored.items():
                if fresh and c.generated and r.get(p) is None:
                    if c.generated == "uuid":
                        r[p] = str(uuid.uuid4())
                    else:
                        if following is None:
                            following = (self._table(entity)[0].agg(F.max(p)).head()[0] or 0) + 1
                        r[p], following = following, following + 1
                if c.role == "tenant":
                    if current_tenant() is not None and r.get(p) not in (None, current_tenant()):
                        raise TenantError(f"{entity.name} of another tenant")
                    r.setdefault(p, current_tenant())
                if c.role == "version" and fresh:
                    r.setdefault(p, 1)
            if fresh:
                for p, c in entity.stored.items():
                    r.setdefault(p, None)
                    if not c.nullable and r[p] is None and not c.role:
                        raise ValidationError(f"{entity.name}.{p} is required")
            for p in r:
                for check in entity.columns[p].checks:
                    check(f"{entity.name}.{p}", r[p])
            out.append(r)
        return out

    def _as_frame(self, entity: Entity, rows: list[dict]) -> DataFrame:
        """Rows as a DataFrame of the stored types, managed times filled in."""
        names = list(entity.stored)
        df = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` {entity.columns[n].spark_type()}" for n in names))
        for role in ("created_at", "updated_at"):
            p = entity.role(role)
            if p:
                df = df.withColumn(p, F.coalesce(p, F.current_timestamp().cast(entity.columns[p].spark_type())))
        return df

    def insert_many(self, name: str, rows: list[dict] | DataFrame) -> int:
        """Append; a DataFrame stays distributed. Unique columns are checked."""
        entity = self.catalog.entity(name)
        if isinstance(rows, DataFrame):
            df, n = rows.select(*entity.stored), None
        else:
            self.events.emit("before_insert", name, rows)
            prepared = self._prepared(entity, rows, True)
            df, n = self._as_frame(entity, prepared), len(prepared)
            for given, made in zip(rows, prepared, strict=True):
                given.update({k: made[k] for k in entity.key})
        table, version = self._table(entity)
        self._check_unique(entity, table, df)
        self._commit(entity, table.unionByName(df), version)
        if n is not None:
            self.events.emit("after_insert", name, rows)
        return df.count() if n is None else n

    def insert_many_and_return(self, name: str, rows: list[dict]) -> list[dict]:
        self.insert_many(name, rows)
        return rows

    def _check_unique(self, entity: Entity, table: DataFrame, df: DataFrame) -> None:
        for keys in ([tuple(entity.key)] if entity.key else []) + list(entity.unique):
            keys = list(keys)
            if not df.groupBy(*keys).count().filter("count > 1").isEmpty() or not df.join(table, keys, "left_semi").isEmpty():
                raise ValidationError(f"{entity.name}: a row with these {keys} exists")

    def save(self, name: str, row: dict) -> dict:
        """Insert or update by key: no key or an unknown one inserts. Parents in relations that cascade are saved first, children after."""
        return self.save_many(name, [row])[0]

    def save_many(self, name: str, rows: list[dict]) -> list[dict]:
        entity = self.catalog.entity(name)
        for row in rows:
            for r, relation in entity.relations.items():
                if relation.cascade and relation.kind == "many_to_one" and isinstance(row.get(r), dict):
                    parent = self.save(relation.target, row[r])
                    row[relation.key] = parent[self.catalog.entity(relation.target).key[0]]
        plain = [{k: v for k, v in row.items() if k not in entity.relations} for row in rows]
        known = self.find_keys(entity, [p for p in plain if all(p.get(k) is not None for k in entity.key)])
        fresh = [p for p in plain if tuple(p.get(k) for k in entity.key) not in known]
        old = [p for p in plain if tuple(p.get(k) for k in entity.key) in known]
        if fresh:
            self.insert_many(name, fresh)
        if old:
            self._update_rows(entity, old)
        for row, p in zip(rows, plain, strict=True):
            row.update({k: p[k] for k in entity.key})
            for r, relation in entity.relations.items():
                if relation.cascade and relation.kind == "one_to_many" and isinstance(row.get(r), list) and row[r]:
                    for child in row[r]:
                        child[relation.key] = row[entity.key[0]]
                    self.save_many(relation.target, row[r])
        return rows

    def find_keys(self, entity: Entity, rows: list[dict]) -> set[tuple]:
        if not rows:
            return set()
        wanted = self.spark.createDataFrame([tuple(r[k] for k in entity.key) for r in rows], ", ".join(f"`{k}` {entity.columns[k].spark_type()}" for k in entity.key))
        return {tuple(r) for r in self._table(entity)[0].join(wanted, entity.key, "left_semi").select(*entity.key).collect()}

    def _update_rows(self, entity: Entity, rows: list[dict]) -> None:
        """Rows by key; columns that a row lacks keep their value. A stale version is an error."""
        self.events.emit("before_update", entity.name, rows)
        groups: dict[tuple, list[dict]] = defaultdict(list)
        for r in self._prepared(entity, rows, False):
            groups[tuple(sorted(r))].append(r)
        version_column, touched = entity.role("version"), entity.role("updated_at")
        for names, own in groups.items():
            table, version = self._table(entity)
            given = self.spark.createDataFrame([tuple(r[n] for n in names) for r in own], ", ".join(f"`{n}` {entity.columns[n].spark_type()}" for n in names))
            if version_column in names:
                stale = given.alias("n").join(table.alias("o"), [F.col(f"n.{k}") == F.col(f"o.{k}") for k in entity.key]).filter(F.col(f"n.{version_column}") != F.col(f"o.{version_column}"))
                if not stale.isEmpty():
                    raise OptimisticLockError(entity.name)
            sets = {n: write.excluded(n) for n in names if n not in entity.key and n != version_column}
            if version_column:
                sets[version_column] = F.col(f"__old.{version_column}") + 1
            if touched and touched not in names:
                sets[touched] = F.current_timestamp()
            self._commit(entity, write.upsert(table, given, entity.key, sets), version)
        self.events.emit("after_update", entity.name, rows)

    def _scoped(self, entity: Entity, where, need: bool = True):
        """The rows a criteria write may touch: the condition, the tenant, and none without a condition."""
        if need and (where is None or isinstance(where, (dict, list)) and not where):
            raise InvalidQuery("a write by criteria needs a condition")
        c = compile_where(where, "", entity, self.catalog)
        owner = entity.role("tenant")
        if owner and current_tenant() is not None:
            c = c & (F.col(owner) == F.lit(current_tenant()))
        return c

    def update_many(self, name: str, where, assign: dict, order=None, limit: int | None = None) -> int:
        """SET values or expressions where the condition holds; nothing to set changes nothing."""
        entity = self.catalog.entity(name)
        if not assign:
            return 0
        entity.check(assign)
        c = self._scoped(entity, where)
        table, version = self._table(entity)
        n = table.filter(c).count() if limit is None else min(limit, table.filter(c).count())
        sets = dict(assign)
        if entity.role("version"):
            sets.setdefault(entity.role("version"), F.col(entity.role("version")) + 1)
        if entity.role("updated_at"):
            sets.setdefault(entity.role("updated_at"), F.current_timestamp())
        self._commit(entity, write.update(table, c, sets, order, limit, entity.key), version)
        return n

    update = update_many

    def increment(self, name: str, where, prop: str, by=1) -> int:
        return self.update_many(name, where, {prop: F.col(prop) + by})

    def decrement(self, name: str, where, prop: str, by=1) -> int:
        return self.increment(name, where, prop, -by)

    def delete(self, name: str, where) -> int:
        entity = self.catalog.entity(name)
        c = self._scoped(entity, where)
        self.events.emit("before_delete", name, where)
        table, version = self._table(entity)
        gone = table.filter(c)
        n = gone.count()
        self._cascade(entity, gone, lambda target, keys, key: self._delete_children(target, keys, key))
        self._commit(entity, write.delete(table, c), version)
        self.events.emit("after_delete", name, where)
        return n

    def _cascade(self, entity: Entity, rows: DataFrame, act: Callable[[Entity, DataFrame, str], None]) -> None:
        for relation in entity.relations.values():
            if relation.cascade and relation.kind == "one_to_many":
                act(self.catalog.entity(relation.target), rows.select(F.col(entity.key[0]).alias("__parent")), relation.key)

    def _delete_children(self, target: Entity, parents: DataFrame, key: str) -> None:
        table, version = self._table(target)
        on = F.col(key) == F.col("__parent")
        self._cascade(target, table.join(parents, on, "left_semi"), lambda t, p, k: self._delete_children(t, p, k))
        self._commit(target, table.join(parents, on, "left_anti"), version)

    def delete_many(self, name: str, keys: list) -> int:
        entity = self.catalog.entity(name)
        if not keys:
            return 0
        return self.delete(name, {"OR": [self._key(entity, k) for k in keys]})

    def remove(self, name: str, row: dict) -> int:
        return self.delete_many(name, [{k: row[k] for k in self.catalog.entity(name).key}])

    def clear(self, name: str) -> None:
        entity = self.catalog.entity(name)
        table, version = self._table(entity)
        self._commit(entity, table.limit(0), version)

    def soft_delete(self, name: str, where) -> int:
        return self._mark(name, where, lambda table, c, p: write.soft_delete(table, c, p), True)

    def restore(self, name: str, where) -> int:
        return self._mark(name, where, lambda table, c, p: write.restore(table, c, p), False)

    def _mark(self, name: str, where, change: Callable, live: bool) -> int:
        entity = self.catalog.entity(name)
        p = entity.role("deleted_at")
        if p is None:
            raise QuillError(f"{name} has no deleted_at column")
        c = self._scoped(entity, where) & (F.col(p).isNull() if live else F.col(p).isNotNull())
        table, version = self._table(entity)
        hit = table.filter(c)
        n = hit.count()

        def child(target: Entity, parents: DataFrame, key: str) -> None:
            own = target.role("deleted_at")
            if own is None:
                return
            rows, v = self._table(target)
            marked = rows.join(parents.withColumn("__hit", F.lit(True)).distinct(), F.col(key) == F.col("__parent"), "left")
            self._commit(target, change(marked, F.col("__hit").isNotNull(), own).select(*rows.columns), v)

        self._cascade(entity, hit, child)
        self._commit(entity, change(table, c, p), version)
        return n

    def upsert(self, name: str, row: dict, keys: list[str] | None = None, **more) -> None:
        self.batch_upsert(name, [row], keys, **more)

    def batch_upsert(self, name: str, rows: list[dict] | DataFrame, keys: list[str] | None = None, assign=None, where=None) -> None:
        """ON CONFLICT (keys) DO UPDATE; of rows that share a key the first is taken. A revived row loses its deletion mark."""
        entity = self.catalog.entity(name)
        keys = keys or entity.key
        if isinstance(rows, DataFrame):
            df, given = rows, [c for c in rows.columns if c in entity.stored]
        else:
            given = sorted({k for r in rows for k in r})
            df = self._as_frame(entity, self._prepared(entity, rows, True))
        table, version = self._table(entity)
        sets: dict[str, Any] = {c: write.excluded(c) for c in given if c not in keys} if assign is None else {c: write.excluded(c) for c in assign} if isinstance(assign, list) else dict(assign)
        if sets:
            for role, value in (("version", lambda p: F.col(f"__old.{p}") + 1), ("updated_at", lambda p: F.current_timestamp()), ("deleted_at", lambda p: F.lit(None))):
                p = entity.role(role)
                if p and p not in given:
                    sets[p] = value(p)
        self._commit(entity, write.upsert(table, df, keys, sets, where), version)

    def insert_ignore(self, name: str, rows: list[dict], keys: list[str] | None = None) -> None:
        self.batch_upsert(name, rows, keys, assign=[])

    def insert_builder(self, name: str) -> InsertBuilder:
        return InsertBuilder(self, self.catalog.entity(name))

    def update_builder(self, name: str) -> UpdateBuilder:
        return UpdateBuilder(self, self.catalog.entity(name))

    def _bridge(self, name: str, relation: str) -> tuple[Relation, Entity]:
        r = self.catalog.entity(name).relations[relation]
        return r, self.catalog.entity(r.through)

    def attach_relation(self, name: str, relation: str, key, others: list) -> None:
        r, bridge = self._bridge(name, relation)
        table, version = self._table(bridge)
        links = self.spark.createDataFrame([(key, o) for o in others], f"`{r.through_own}` {bridge.columns[r.through_own].spark_type()}, `{r.through_other}` {bridge.columns[r.through_other].spark_type()}")
        self._commit(bridge, write.attach(table.select(*links.columns), links), version)

    def detach_relation(self, name: str, relation: str, key, others: list) -> None:
        r, bridge = self._bridge(name, relation)
        table, version = self._table(bridge)
        gone = (F.col(r.through_own) == F.lit(key)) & F.col(r.through_other).isin(list(others))
        self._commit(bridge, write.delete(table, gone), version)

    @contextlib.contextmanager
    def advisory_lock(self, name: str, wait: float = 10.0) -> Iterator[None]:
        """Hold a named lock among all managers of this root; QuillError if it isn't free within ``wait`` seconds.

        A file under the root that only one can create. One that a dead process
        has left must be removed by hand.
        """
        if self.root is None:
            raise QuillError("an advisory lock needs a manager with a root")
        locks, until = Snapshots(self.spark, f"{self.root}/_locks/{name}", None), time.monotonic() + wait
        while not locks._claim(1, "held"):
            if time.monotonic() > until:
                raise QuillError(f"the lock {name!r} is taken")
            time.sleep(0.05)
        try:
            yield
        finally:
            locks._remove("_commits")

    @contextlib.contextmanager
    def transaction(self) -> Iterator[WriteBuffer]:
        """A unit of work: committed at the end, forgotten on an error in the block.

        Tables are swapped one by one, so readers may see some of them changed
        already. Where a write fails half way, the tables changed before it are
        set back to the version they had, unless another writer has come after.
        """
        buffer = WriteBuffer(self)
        yield buffer
        stores = [s for _, s in self.catalog.entities.values() if isinstance(s, (Snapshots, Memory))]
        before = [s.current() for s in stores]
        try:
            buffer.flush()
        except Exception:
            for store, version in zip(stores, before, strict=True):
                if store.current() not in (version, None) and store.current() == store.last:
                    store.set_back(version)
            raise

    def transactional(self, work: Callable) -> Callable:
        """Decorator: work(buffer, ...) runs in a unit of work."""

        @functools.wraps(work)
        def run(*args, **more):
            with self.transaction() as buffer:
                return work(buffer, *args, **more)

        return run

    def with_tenant(self, value):
        return tenant(value)

    def for_each_tenant(self, values: list, work: Callable) -> dict:
        out = {}
        for v in values:
            with tenant(v):
                out[v] = work(self)
        return out

    def buffer(self) -> WriteBuffer:
        return WriteBuffer(self)


def read_shape(df: DataFrame, shape) -> DataFrame:
    """The columns of a StructType, cast; a missing one is an error."""
    missing = [f.name for f in shape.fields if f.name not in df.columns]
    if missing:
        raise InvalidQuery(f"the result lacks {missing}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in shape.fields])


class Repository:
    """The manager's calls for one entity."""

    def __init__(self, manager: EntityManager, entity: Entity):
        self.manager, self.entity = manager, entity

    def __getattr__(self, name: str):
        call = getattr(self.manager, name)
        return lambda *args, **more: call(self.entity.name, *args, **more)


@dataclass
class InsertBuilder:
    """values(...).on_conflict(...).do_nothing() or .do_update(...); execute()."""

    manager: EntityManager
    entity: Entity
    rows: Any = None
    keys: list[str] | None = None
    assign: Any = "none"
    guard: Any = None

    def values(self, rows) -> InsertBuilder:
        """Row dictionaries, one of them, or a query."""
        self.rows = [rows] if isinstance(rows, dict) else rows.to_df() if hasattr(rows, "to_df") else rows
        return self

    def on_conflict(self, *keys: str) -> InsertBuilder:
        self.entity.check(keys)
        self.keys = list(keys)
        return self

    def on_conflict_constraint(self, position: int) -> InsertBuilder:
        """The keys of one of the entity's unique groups."""
        return self.on_conflict(*self.entity.unique[position])

    def do_nothing(self) -> InsertBuilder:
        self.assign = []
        return self

    def do_update(self, assign=None, where=None) -> InsertBuilder:
        """Names to take over, {name: expression over __old and __new}, or all."""
        self.assign, self.guard = assign, None if where is None else column(where)
        return self

    do_update_where = do_update

    def execute(self) -> None:
        if self.rows is None:
            raise InvalidQuery("an insert needs values")
        if self.keys is None:
            self.manager.insert_many(self.entity.name, self.rows)
        else:
            self.manager.batch_upsert(self.entity.name, self.rows, self.keys, self.assign, self.guard)

    def execute_and_return(self) -> DataFrame:
        """RETURNING: the stored rows that were inserted or updated, generated and managed columns filled in.

        Rows that a conflict left as they were are not among them.
        """
        before = self.manager._table(self.entity)[0]
        if not hasattr(self.rows, "sparkSession") and self.rows is not None:
            self.rows = [dict(r) for r in self.rows]
        self.execute()
        after, keys = self.manager._table(self.entity)[0], self.keys or list(self.entity.key)
        kinds = ", ".join(f"`{k}` {self.entity.columns[k].spark_type()}" for k in keys)
        proposed = self.rows if hasattr(self.rows, "sparkSession") else self.manager.spark.createDataFrame([tuple(r.get(k) for k in keys) for r in self.rows], kinds)
        written = proposed.select(*keys).distinct()
        if self.keys is not None:
            fresh = written.join(before, keys, "left_anti")
            if isinstance(self.assign, list) and not self.assign:
                written = fresh
            elif self.guard is not None:
                given = proposed if hasattr(self.rows, "sparkSession") else self.manager._as_frame(self.entity, self.rows)
                on = [F.col(f"__old.{k}") == F.col(f"__new.{k}") for k in keys]
                changed = before.alias("__old").join(write.one_per_key(given, keys).alias("__new"), on).filter(self.guard)
                written = fresh.unionByName(changed.select(*[F.col(f"__new.{k}").alias(k) for k in keys]))
        return after.join(written, keys, "left_semi")


@dataclass
class UpdateBuilder:
    """set(...), set_raw(...), where(...), order_by(...), limit(n); execute()."""

    manager: EntityManager
    entity: Entity
    assign: dict = field(default_factory=dict)
    condition: Any = None
    order: tuple = ()
    most: int | None = None

    def set(self, **values) -> UpdateBuilder:
        self.assign |= values
        return self

    def set_raw(self, **texts: str) -> UpdateBuilder:
        self.assign |= {k: F.expr(v) for k, v in texts.items()}
        return self

    def where(self, where) -> UpdateBuilder:
        c = compile_where(where, "", self.entity, self.manager.catalog)
        self.condition = c if self.condition is None else self.condition & c
        return self

    and_where = where

    def or_where(self, where) -> UpdateBuilder:
        c = compile_where(where, "", self.entity, self.manager.catalog)
        self.condition = c if self.condition is None else self.condition | c
        return self

    def order_by(self, *keys) -> UpdateBuilder:
        self.order = keys
        return self

    def limit(self, n: int) -> UpdateBuilder:
        self.most = n
        return self

    def execute(self) -> int:
        return self.manager.update_many(self.entity.name, self.condition, self.assign, list(self.order), self.most)


def topological_sort(names: list[str], parents: dict[str, set[str]]) -> list[str]:
    """Parents before children; within a cycle the given order holds."""
    out: list[str] = []
    rest = list(names)
    while rest:
        free = next((n for n in rest if not (parents.get(n, set()) & set(rest)) - {n}), rest[0])
        out.append(free)
        rest.remove(free)
    return out


class WriteBuffer:
    """Changes staged by entity and committed together, parents first; deletes run last, children first.

    Rows found through the buffer are tracked: what differs from the state they
    were read in is written at the flush.
    """

    def __init__(self, manager: EntityManager):
        self.manager = manager
        self.known: dict[tuple, tuple[dict, dict]] = {}  # (entity, key) -> row, state read
        self.new: dict[str, list[dict]] = defaultdict(list)
        self.gone: dict[str, list[dict]] = defaultdict(list)
        self.bulk: list[tuple[str, Callable]] = []
        self.read_only: set[tuple] = set()

    def _id(self, name: str, row: dict) -> tuple:
        return name, tuple(row[k] for k in self.manager.catalog.entity(name).key)

    def track(self, name: str, row: dict) -> dict:
        """The one tracked row with this key."""
        return self.known.setdefault(self._id(name, row), (row, dict(row)))[0]

    def find(self, name: str, **options) -> list[dict]:
        return [self.track(name, r) for r in self.manager.find(name, **options)]

    def find_one(self, name: str, key) -> dict | None:
        entity = self.manager.catalog.entity(name)
        at = name, tuple(self.manager._key(entity, key)[k] for k in entity.key)
        if at in self.known:
            return self.known[at][0]
        row = self.manager.find_by_pk(name, key)
        return None if row is None else self.track(name, row)

    def reference(self, name: str, key) -> dict:
        """The key alone, for use as a parent."""
        return dict(self.manager._key(self.manager.catalog.entity(name), key))

    def persist(self, name: str, row: dict) -> dict:
        self.new[name].append(row)
        return row

    save = persist

    def remove(self, name: str, row: dict) -> None:
        if any(row is r for r in self.new[name]):
            self.new[name] = [r for r in self.new[name] if r is not row]
            return
        self.known.pop(self._id(name, row), None)
        self.gone[name].append({k: row[k] for k in self.manager.catalog.entity(name).key})

    delete = remove

    def merge(self, name: str, row: dict) -> dict:
        """Bring a detached row's values onto the tracked one."""
        entity = self.manager.catalog.entity(name)
        own = self.find_one(name, {k: row[k] for k in entity.key})
        if own is None:
            return self.persist(name, dict(row))
        own.update(row)
        return own

    def refresh(self, name: str, row: dict) -> dict:
        fresh = self.manager.find_by_pk(name, {k: row[k] for k in self.manager.catalog.entity(name).key})
        if fresh is None:
            raise EntityNotFound(name)
        row.clear()
        row.update(fresh)
        self.known[self._id(name, row)] = row, dict(row)
        return row

    def detach(self, name: str, row: dict) -> None:
        self.known.pop(self._id(name, row), None)

    def detach_all(self) -> None:
        self.known.clear()

    def mark_read_only(self, name: str, row: dict) -> None:
        self.read_only.add(self._id(name, row))

    def update_many(self, name: str, where, assign: dict) -> None:
        self.bulk.append((name, lambda: self.manager.update_many(name, where, assign)))

    def delete_many(self, name: str, where) -> None:
        self.bulk.append((name, lambda: self.manager.delete(name, where)))

    def compute_changes(self) -> dict[tuple, dict]:
        """What tracked rows differ in."""
        out = {}
        for at, (row, was) in self.known.items():
            changed = {k: v for k, v in row.items() if k not in was or was[k] != v}
            if changed and at not in self.read_only:
                out[at] = changed
        return out

    dirty = compute_changes

    def preview(self) -> dict:
        return {"update": self.compute_changes(), "insert": {k: list(v) for k, v in self.new.items() if v}, "delete": {k: list(v) for k, v in self.gone.items() if v}, "bulk": [n for n, _ in self.bulk]}

    def _order(self, names) -> list[str]:
        parents = {n: {r.target for r in self.manager.catalog.entity(n).relations.values() if r.kind == "many_to_one"} for n in names}
        for n in names:
            for r in self.manager.catalog.entity(n).relations.values():
                if r.kind == "one_to_many" and r.target in parents:
                    parents[r.target].add(n)
        return topological_sort(list(names), parents)

    def flush(self) -> None:
        changes: dict[str, list[dict]] = defaultdict(list)
        for (name, key), changed in self.compute_changes().items():
            entity = self.manager.catalog.entity(name)
            row = self.known[name, key][0]
            version = {entity.role("version"): row[entity.role("version")]} if entity.role("version") else {}
            changes[name].append(dict(zip(entity.key, key, strict=True)) | version | {k: v for k, v in changed.items() if k in entity.stored})
        for name in self._order(changes):
            self.manager._update_rows(self.manager.catalog.entity(name), changes[name])
        for name in self._order([n for n, rows in self.new.items() if rows]):
            self.manager.save_many(name, self.new[name])
        for _, run in self.bulk:
            run()
        for name in reversed(self._order([n for n, rows in self.gone.items() if rows])):
            self.manager.delete_many(name, self.gone[name])
        for at, (row, _) in list(self.known.items()):
            self.known[at] = row, dict(row)
        self.clear()

    def clear(self) -> None:
        self.new.clear()
        self.gone.clear()
        self.bulk.clear()


# checks of values before they are written


def min_length(n: int):
    def check(where: str, v) -> None:
        if v is not None and len(v) < n:
            raise ValidationError(f"{where} is shorter than {n}")

    return check


def max_length(n: int):
    def check(where: str, v) -> None:
        if v is not None and len(v) > n:
            raise ValidationError(f"{where} is longer than {n}")

    return check


def at_least(n):
    def check(where: str, v) -> None:
        if v is not None and v < n:
            raise ValidationError(f"{where} is below {n}")

    return check


def at_most(n):
    def check(where: str, v) -> None:
        if v is not None and v > n:
            raise ValidationError(f"{where} is above {n}")

    return check


def not_null(where: str, v) -> None:
    if v is None:
        raise ValidationError(f"{where} is required")


def one_of(*values):
    def check(where: str, v) -> None:
        if v is not None and v not in values:
            raise ValidationError(f"{where} is none of {values}")

    return check
