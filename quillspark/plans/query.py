"""SelectQuery: an immutable builder over an entity or a DataFrame that yields one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.errors import EntityNotFound, InvalidQuery
from quillspark.functions.expr import Agg, Expr, as_expr, column, order_of
from quillspark.operators import ordered_sets, paging, relations
from quillspark.operators.range_join import range_join
from quillspark.plans.where import compare, compile_where, relation_filter
from quillspark.sources.entity import Entity
from quillspark.streaming.batches import batched_rows


class JoinOn:
    """The condition of a join: columns with any operator, literals, ranges, nulls and lists, all of which hold."""

    def __init__(self, condition: Column | None = None, ranges: tuple = (), equal: bool = False):
        self.condition, self.ranges, self.equal = condition, ranges, equal

    def _and(self, c: Column, span: tuple | None = None, equal: bool = False) -> JoinOn:
        ranges = self.ranges if span is None else (*self.ranges, span)
        return JoinOn(c if self.condition is None else self.condition & c, ranges, self.equal or equal)

    def on(self, left: str, sign: str, right: str) -> JoinOn:
        if sign.upper() == "LIKE":
            return self._and(F.col(left).like(F.col(right)))
        return self._and(column(compare(F.col(left), sign, F.col(right))), equal=sign == "=")

    and_on = on

    def on_val(self, left: str, sign: str, value) -> JoinOn:
        return self._and(column(compare(F.col(left), sign, value)))

    def on_between(self, point: str, low: str, high: str) -> JoinOn:
        """Where no equality of columns comes with it, an inner or left join meets in cells of the axis (see range_join)."""
        return self._and(F.col(point).between(F.col(low), F.col(high)), (point, low, high))

    and_on_between = on_between

    def on_val_between(self, left: str, low, high) -> JoinOn:
        return self._and(F.col(left).between(low, high))

    def on_null(self, name: str) -> JoinOn:
        return self._and(F.col(name).isNull())

    def on_not_null(self, name: str) -> JoinOn:
        return self._and(F.col(name).isNotNull())

    def on_in(self, name: str, values: list) -> JoinOn:
        return self._and(F.col(name).isin(values) if values else F.lit(False))


class WhereGroup:
    """A parenthesised group of conditions; each call adds one with AND, or_where with OR."""

    def __init__(self):
        self.condition: Column | None = None

    def _add(self, c, any_: bool = False) -> WhereGroup:
        c = column(c)
        self.condition = c if self.condition is None else (self.condition | c if any_ else self.condition & c)
        return self

    def where(self, *args) -> WhereGroup:
        return self._add(_condition(args))

    and_where = where

    def or_where(self, *args) -> WhereGroup:
        return self._add(_condition(args), True)

    def where_in(self, name, values) -> WhereGroup:
        return self._add(as_expr(name).in_(values))

    def where_not_in(self, name, values) -> WhereGroup:
        return self._add(as_expr(name).not_in(values))

    def where_null(self, name) -> WhereGroup:
        return self._add(as_expr(name).is_null())

    def where_not_null(self, name) -> WhereGroup:
        return self._add(as_expr(name).is_not_null())

    def where_between(self, name, low, high) -> WhereGroup:
        return self._add(as_expr(name).between(low, high))

    def where_like(self, name, pattern) -> WhereGroup:
        return self._add(as_expr(name).like(pattern))

    def build(self) -> Column:
        if self.condition is None:
            raise InvalidQuery("an empty group of conditions")
        return self.condition


def _condition(args: tuple) -> Column:
    if len(args) == 1:
        return compile_where(args[0])
    if len(args) == 2:
        return as_expr(args[0]).eq(args[1]).column
    if len(args) == 3:
        return compare(*args).column
    raise InvalidQuery("where takes a condition, (column, value) or (column, operator, value)")


def _named(name_or_expr) -> Column:
    return as_expr(name_or_expr).column


@dataclass(frozen=True)
class SelectQuery:
    """Steps apply in this order: scope, joins, filter, group, having, windows and projection, distinct, sort, offset, limit."""

    catalog: Any
    entity: Entity | None
    source: DataFrame
    name: str = "t"
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    condition: Column | None = None
    keys: tuple = ()
    rollup_: bool = False
    aggregates: tuple = ()
    having_: Column | None = None
    projections: tuple = ()
    added: tuple = ()
    distinct_: bool = False
    distinct_on_: tuple = ()
    order: tuple = ()
    limit_: int | None = None
    offset_: int | None = None
    hints: tuple = ()
    checks: tuple = ()
    after: tuple = ()
    fan_out: bool = False
    scope_: dict = field(default_factory=dict)

    # where
    def where(self, *args) -> SelectQuery:
        """A condition, a dictionary (relations included), (column, value) or (column, operator, value); calls add up with AND."""
        return self._and(self._condition(args))

    def _condition(self, args: tuple) -> Column:
        if len(args) == 1 and isinstance(args[0], (dict, list)) and self.entity is not None:
            return compile_where(args[0], "", self.entity, self.catalog, self.scope_.get("with_deleted", False))
        return _condition(args)

    and_where = where

    def _and(self, c: Column) -> SelectQuery:
        return replace(self, condition=c if self.condition is None else self.condition & c)

    def or_where(self, *args) -> SelectQuery:
        """All conditions so far, or this one."""
        c = self._condition(args)
        return replace(self, condition=c if self.condition is None else self.condition | c)

    def and_where_group(self, build: Callable[[WhereGroup], WhereGroup]) -> SelectQuery:
        return self._and(build(WhereGroup()).build())

    def or_where_group(self, build: Callable[[WhereGroup], WhereGroup]) -> SelectQuery:
        return self.or_where(build(WhereGroup()).build())

    def where_in(self, name, values) -> SelectQuery:
        return self._and(as_expr(name).in_(values).column)

    def where_not_in(self, name, values) -> SelectQuery:
        return self._and(as_expr(name).not_in(values).column)

    def where_null(self, name) -> SelectQuery:
        return self._and(as_expr(name).is_null().column)

    def where_not_null(self, name) -> SelectQuery:
        return self._and(as_expr(name).is_not_null().column)

    def where_between(self, name, low, high) -> SelectQuery:
        return self._and(as_expr(name).between(low, high).column)

    def where_like(self, name, pattern) -> SelectQuery:
        return self._and(as_expr(name).like(pattern).column)

    def _step(self, f: Callable[[DataFrame], DataFrame]) -> SelectQuery:
        """Apply f after what was said so far."""
        steps = self.steps
        if self.condition is not None:
            c = self.condition
            steps = (*steps, lambda df: df.filter(c))
        return replace(self, steps=(*steps, f), condition=None)

    def where_in_subquery(self, name: str, sub, sub_column: str | None = None) -> SelectQuery:
        """column IN (subquery): a semi join on the first or the named column."""
        rows = _frame(sub)
        value = rows.select(F.col(sub_column or rows.columns[0]).alias("__in"))
        return self._step(lambda df: df.join(value, F.col(name) == F.col("__in"), "left_semi"))

    def where_not_in_subquery(self, name: str, sub, sub_column: str | None = None) -> SelectQuery:
        """column NOT IN (subquery), with SQL's rule for nulls: none pass if the list holds one, and a null passes only an empty list."""
        rows = _frame(sub)
        value = rows.select(F.col(sub_column or rows.columns[0]).alias("__in"))

        def step(df: DataFrame) -> DataFrame:
            rest = df.join(value, F.col(name) == F.col("__in"), "left_anti")
            everything, known = value.agg(F.count("*")).scalar(), value.agg(F.count("__in")).scalar()
            return rest.filter((everything == 0) | (F.col(name).isNotNull() & (everything == known)))

        return self._step(step)

    def where_exists(self, sub, on: Column | Expr) -> SelectQuery:
        """EXISTS (subquery), correlated by a condition over both sides' columns."""
        rows = _frame(sub)
        return self._step(lambda df: df.join(rows, column(on), "left_semi"))

    def where_not_exists(self, sub, on: Column | Expr) -> SelectQuery:
        rows = _frame(sub)
        return self._step(lambda df: df.join(rows, column(on), "left_anti"))

    def where_has(self, relation: str, where: dict | None = None) -> SelectQuery:
        return self._related(relation, where, "left_semi")

    def where_not_has(self, relation: str, where: dict | None = None) -> SelectQuery:
        return self._related(relation, where, "left_anti")

    def _related(self, relation: str, where: dict | None, how: str) -> SelectQuery:
        self.entity.check([relation])
        many = self.entity.relations[relation].kind in ("one_to_many", "many_to_many")
        mode = {("left_semi", True): "some", ("left_semi", False): "is", ("left_anti", True): "none", ("left_anti", False): "is_not"}[how, many]
        return self._and(relation_filter(self.catalog, self.entity, relation, {mode: where or {}}, self.scope_.get("with_deleted", False)))

    # scopes
    def with_deleted(self) -> SelectQuery:
        return self._rescoped(with_deleted=True)

    def without_tenant_scope(self) -> SelectQuery:
        return self._rescoped(tenant_scope=False)

    def _rescoped(self, **more) -> SelectQuery:
        scope = self.scope_ | more
        return replace(self, scope_=scope, source=self.catalog.scan(self.entity, **scope).alias(self.name))

    def apply_scope(self, name: str, *args) -> SelectQuery:
        return self.entity.scopes[name](self, *args)

    # joins
    def _join(self, other, on, how: str, name: str | None = None) -> SelectQuery:
        rows = self.catalog.scan(other) if isinstance(other, (str, Entity)) and self.catalog is not None else _frame(other)
        rows = rows.alias(name) if name else rows
        made = on(JoinOn()) if callable(on) and not isinstance(on, Column) else on
        c = made.condition if isinstance(made, JoinOn) else column(made)
        if isinstance(made, JoinOn) and made.ranges and not made.equal and how in ("inner", "left"):
            return self._step(lambda df: _in_cells(df, rows, made.ranges[0], c, how))
        return self._step(lambda df: df.join(rows, c, how))

    def inner_join(self, other, on, name: str | None = None) -> SelectQuery:
        """Join an entity (scoped before the join, so outer joins keep their rows), a query or a DataFrame."""
        return self._join(other, on, "inner", name)

    def left_join(self, other, on, name: str | None = None) -> SelectQuery:
        return self._join(other, on, "left", name)

    def right_join(self, other, on, name: str | None = None) -> SelectQuery:
        return self._join(other, on, "right", name)

    def _join_relation(self, relation: str, how: str, name: str | None) -> SelectQuery:
        self.entity.check([relation])
        rows, keys = relations.related(self.catalog, self.entity, relation)
        label = name or relation
        rows = rows.alias(label)
        c = F.lit(True)
        for i, (own, other) in enumerate(keys):
            here = F.col(f"{self.name}.{own}") == F.col(f"{label}.{other}")
            c = here if i == 0 else c & here
        many = self.entity.relations[relation].kind in ("one_to_many", "many_to_many")
        return replace(self._step(lambda df: df.join(rows, c, how)), fan_out=self.fan_out or many)

    def left_join_relation(self, relation: str, name: str | None = None) -> SelectQuery:
        return self._join_relation(relation, "left", name)

    def inner_join_relation(self, relation: str, name: str | None = None) -> SelectQuery:
        return self._join_relation(relation, "inner", name)

    def load_relation(self, relation: str, **options) -> SelectQuery:
        """LEFT JOIN and select: the related rows as a nested column, one row for each root."""
        self.entity.check([relation])
        return replace(self, after=(*self.after, lambda df: relations.load_relation(self.catalog, df, self.entity, relation, options)))

    left_join_and_select = left_join_relation_and_select = load_relation

    def inner_join_and_select(self, relation: str, **options) -> SelectQuery:
        return self.where_has(relation, options.get("where")).load_relation(relation, **options)

    inner_join_relation_and_select = inner_join_and_select

    def with_count(self, relation: str, alias: str | None = None, where=None) -> SelectQuery:
        self.entity.check([relation])
        return replace(self, after=(*self.after, lambda df: relations.with_count(self.catalog, df, self.entity, relation, alias, where)))

    def hint(self, name: str, *args) -> SelectQuery:
        """A planner hint, such as broadcast or merge."""
        return replace(self, hints=(*self.hints, (name, args)))

    def _no_op(self, *_args) -> SelectQuery:
        """Index hints and row locks have no counterpart here; they are accepted and change nothing."""
        return self

    use_index = force_index = ignore_index = for_update = for_share = for_update_nowait = for_update_skip_locked = for_share_nowait = for_share_skip_locked = _no_op

    # projection
    def select(self, *items) -> SelectQuery:
        """Names, expressions, aggregates, or {name: True}; replaces the list."""
        flat = []
        for x in items:
            flat += [k for k, on in x.items() if on] if isinstance(x, dict) else x if isinstance(x, (list, tuple)) else [x]
        return replace(self, projections=tuple(flat))

    select_aliased = select

    def select_raw(self, *texts: str) -> SelectQuery:
        return replace(self, projections=tuple(Expr(F.expr(t)) for t in texts))

    def add_select(self, item, alias: str | None = None) -> SelectQuery:
        """One more column; a function gets as_expr and returns the expression."""
        made = item(as_expr) if callable(item) and not isinstance(item, (Expr, Column)) else as_expr(item)
        return replace(self, added=(*self.added, made.as_(alias) if alias else made))

    def select_aggregates(self, *aggregates: tuple) -> SelectQuery:
        """(function, column[, alias]): named agg_<function>_<column> by default."""
        made = []
        for fn, name, *alias in aggregates:
            fn, distinct = (fn[: -len("_distinct")], True) if fn.endswith("_distinct") else (fn, False)
            label = alias[0] if alias else f"agg_{fn}_{'distinct_' if distinct else ''}{'all' if name == '*' else name}"
            made.append(Agg(fn, F.lit(1) if name == "*" else F.col(name), distinct).as_(label))
        return replace(self, aggregates=(*self.aggregates, *made))

    def add_select_subquery(self, sub, alias: str, on: tuple[str, str] | None = None, default=None) -> SelectQuery:
        """A scalar subquery as a column. With ``on`` = (own column, column of sub), sub has a row for each key at most."""
        rows = _frame(sub)
        if on is None:
            return self.add_select(Expr(rows.scalar()), alias)
        own, other = on
        value = next(c for c in rows.columns if c != other)
        slim = rows.select(F.col(other).alias("__sub"), F.col(value).alias(alias))

        def step(df: DataFrame) -> DataFrame:
            met = df.join(slim, F.col(own) == F.col("__sub"), "left").drop("__sub")
            return met if default is None else met.withColumn(alias, F.coalesce(alias, F.lit(default)))

        return self._step(step)

    def distinct(self, on: bool = True) -> SelectQuery:
        return replace(self, distinct_=on)

    set_distinct = distinct

    def distinct_on(self, *keys) -> SelectQuery:
        """The first row of each key in the query's order."""
        return replace(self, distinct_on_=keys)

    def select_schema(self, schema) -> SelectQuery:
        """Fields of a StructType, cast to its types."""
        return self.select(*[Expr(F.col(f.name).cast(f.dataType).alias(f.name)) for f in schema.fields])

    def validate(self, check: Callable[[dict], Any]) -> SelectQuery:
        """check(row) raises, or returns False, for a bad row; it runs where rows reach the driver."""
        return replace(self, checks=(*self.checks, ("row", check)))

    def validate_array(self, check: Callable[[list], Any]) -> SelectQuery:
        return replace(self, checks=(*self.checks, ("all", check)))

    # groups
    def group_by(self, *keys) -> SelectQuery:
        return replace(self, keys=keys)

    def rollup(self, *keys) -> SelectQuery:
        return replace(self, keys=keys, rollup_=True)

    def agg(self, *aggregates) -> SelectQuery:
        return replace(self, aggregates=(*self.aggregates, *aggregates))

    def having(self, condition) -> SelectQuery:
        """Over the aliases of keys and aggregates; calls add up with AND."""
        c = column(condition)
        return replace(self, having_=c if self.having_ is None else self.having_ & c)

    # order and pages
    def order_by(self, *keys) -> SelectQuery:
        """Names, expressions, (name, "asc" | "desc") pairs or a dictionary; nulls last ascending, first descending."""
        flat = []
        for k in keys:
            flat += list(k.items()) if isinstance(k, dict) else [k]
        return replace(self, order=tuple(order_of(k) for k in flat))

    def add_order_by(self, *keys) -> SelectQuery:
        return replace(self, order=(*self.order, *[order_of(k) for k in keys]))

    def limit(self, n: int) -> SelectQuery:
        if n < 0:
            raise InvalidQuery("limit is not negative")
        return replace(self, limit_=n)

    take = limit

    def offset(self, n: int) -> SelectQuery:
        return replace(self, offset_=n)

    skip = offset

    # flow
    def when(self, flag, step: Callable[[SelectQuery], SelectQuery], other: Callable | None = None) -> SelectQuery:
        return step(self) if flag else other(self) if other else self

    def pipe(self, f: Callable[[SelectQuery], Any]) -> Any:
        return f(self)

    def clone(self) -> SelectQuery:
        return self

    # the DataFrame
    def _filtered(self) -> DataFrame:
        df = self.source
        for name, args in self.hints:
            df = df.hint(name, *args)
        for step in self.steps:
            df = step(df)
        return df if self.condition is None else df.filter(self.condition)

    def _shaped(self) -> DataFrame:
        """Everything but the page."""
        df = self._filtered()
        if self.keys or self.aggregates:
            keys = [_named(k) for k in self.keys]
            grouped = (df.rollup if self.rollup_ else df.groupBy)(*keys)
            if self.aggregates and not self.rollup_:
                df = ordered_sets.aggregate(df, keys, self.aggregates)
            else:
                df = grouped.agg(*[column(a) for a in self.aggregates]) if self.aggregates else grouped.agg(F.lit(1).alias("__one")).drop("__one")
            if self.having_ is not None:
                df = df.filter(self.having_)
        for step in self.after:
            df = step(df)
        if self.projections:
            df = df.select(*[_named(p) for p in self.projections], *[column(a) for a in self.added])
        elif self.added:
            df = df.select("*", *[column(a) for a in self.added])
        if self.distinct_on_:
            from pyspark.sql import Window

            at = Window.partitionBy(*[_named(k) for k in self.distinct_on_]).orderBy(*[o.column for o in self.order] or [F.lit(1)])
            df = df.withColumn("__first", F.row_number().over(at)).filter("__first = 1").drop("__first")
        return df.distinct() if self.distinct_ else df

    def to_df(self) -> DataFrame:
        df = self._shaped()
        if self.order and not (self.distinct_on_ and self.limit_ is None):
            df = df.orderBy(*[o.column for o in self.order])
        if self.offset_:
            df = df.offset(self.offset_)
        return df if self.limit_ is None else df.limit(self.limit_)

    as_subquery = as_in_query = as_exists = to_insert_source = to_df

    # set operations
    def union(self, other) -> DataFrame:
        return self.to_df().union(_frame(other)).distinct()

    def union_all(self, other) -> DataFrame:
        return self.to_df().unionAll(_frame(other))

    def intersect(self, other) -> DataFrame:
        return self.to_df().intersect(_frame(other))

    def except_(self, other) -> DataFrame:
        return self.to_df().subtract(_frame(other))

    # terminals
    def _checked(self, rows: list[dict]) -> list[dict]:
        for kind, check in self.checks:
            for given in rows if kind == "row" else [rows]:
                if check(given) is False:
                    raise InvalidQuery(f"a result did not pass {getattr(check, '__name__', 'its check')}")
        return rows

    def get_many(self) -> list[dict]:
        return self._checked([r.asDict(recursive=True) for r in self.to_df().collect()])

    get_raw_many = get_partial_many = get_many

    def get_one(self) -> dict | None:
        rows = self._checked([r.asDict(recursive=True) for r in self.to_df().take(1)])
        return rows[0] if rows else None

    get_raw_one = get_partial_one = get_one

    def get_one_or_fail(self) -> dict:
        row = self.get_one()
        if row is None:
            raise EntityNotFound(self.entity.name if self.entity else self.name)
        return row

    def get_count(self) -> int:
        """Rows without the page; groups where grouped; roots where a relation multiplies them."""
        if self.fan_out and self.entity is not None and not self.keys:
            return self._filtered().select(*[F.col(f"{self.name}.{k}") for k in self.entity.key]).distinct().count()
        return self._shaped().count()

    def get_many_and_count(self) -> tuple[list[dict], int]:
        return self.get_many(), self.get_count()

    get_partial_many_and_count = get_many_and_count

    def get_map(self, name: str) -> dict:
        return {r[name]: r for r in self.get_many()}

    def pluck(self, name: str) -> list:
        return [r[0] for r in self.to_df().select(name).collect()]

    def exists(self) -> bool:
        return not self.limit(1).to_df().isEmpty()

    get_exists = exists

    def _scalar(self, fn: str, name: str):
        """0 over no rows; over a relation that multiplies roots, each root counts once."""
        df = self._filtered()
        if self.fan_out and self.entity is not None:
            df = df.select(*[F.col(f"{self.name}.{k}") for k in self.entity.key], F.col(name).alias("__v")).distinct().select("__v")
        else:
            df = df.select(F.col(name).alias("__v"))
        found = df.agg(getattr(F, fn)("__v")).head()[0]
        return 0 if found is None else found

    def get_sum(self, name: str):
        return self._scalar("sum", name)

    def get_avg(self, name: str):
        return self._scalar("avg", name)

    def get_min(self, name: str):
        return self._scalar("min", name)

    def get_max(self, name: str):
        return self._scalar("max", name)

    def paginate(self, page: int = 1, page_size: int = paging.DEFAULT_SIZE) -> paging.Page:
        return paging.page(self, page, page_size)

    paginate_partial = paginate

    def get_cursor(self, take: int = paging.DEFAULT_SIZE, after: str | None = None) -> paging.CursorPage:
        return paging.cursor_page(self, take, after)

    def stream(self) -> Iterator[dict]:
        for r in self.to_df().toLocalIterator(prefetchPartitions=True):
            yield r.asDict(recursive=True)

    def stream_batch(self, size: int = 1000) -> Iterator[list[dict]]:
        yield from batched_rows(self.to_df(), size)

    def explain(self, mode: str = "formatted") -> str:
        return self.to_df()._jdf.queryExecution().explainString(self.source.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def get_sql(self) -> str:
        """The analysed logical plan; there is no SQL text behind the builder."""
        return self.to_df()._jdf.queryExecution().analyzed().toString()

    def prepare(self, build: Callable[..., SelectQuery]) -> Callable[..., list[dict]]:
        """A query with values to come: build(self, **values) at each call."""
        return lambda **values: build(self, **values).get_many()

    prepare_partial = prepare

    def cache(self) -> SelectQuery:
        """The result so far is kept in the executors' memory and disk until unpersisted."""
        return SelectQuery(self.catalog, self.entity, self.to_df().cache().alias(self.name), self.name)


def _holds(df: DataFrame, *names: str) -> bool:
    try:
        df.select(*names)
    except AnalysisException:
        return False
    return True


def _in_cells(df: DataFrame, rows: DataFrame, span: tuple[str, str, str], condition: Column, how: str) -> DataFrame:
    """A join on low <= point <= high by cells where one side holds the point and the other the bounds; else the plain join."""
    point, low, high = span
    if _holds(df, point) and _holds(rows, low, high):
        return range_join(df, rows, point, low, high, None, how, condition)
    if how == "inner" and _holds(rows, point) and _holds(df, low, high):
        names = [*df.columns, *rows.columns]
        met = range_join(rows, df, point, low, high, None, how, condition)
        return met.select(*[F.col(n) for n in names]) if len(set(names)) == len(names) else met
    return df.join(rows, condition, how)


def _frame(other) -> DataFrame:
    return other if isinstance(other, DataFrame) else other.to_df()


def query(source, name: str = "t", catalog=None, entity: Entity | None = None) -> SelectQuery:
    """A builder over a DataFrame."""
    return SelectQuery(catalog, entity, source.alias(name), name)


