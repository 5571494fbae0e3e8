"""Expressions: a thin fluent layer over Spark columns.

Every call gives Catalyst a built-in function, so filters reach the scan and
projections stay inside generated code. Where dialects differ, PostgreSQL rules
hold (see the README).
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def column(value: Any) -> Column:
    """The Spark column of an expression, or a literal."""
    if isinstance(value, Expr):
        return value.column
    return value if isinstance(value, Column) else F.lit(value)


def as_expr(value: Any) -> Expr:
    """Names and columns become expressions; an expression stays."""
    if isinstance(value, Expr):
        return value
    return Expr(F.col(value) if isinstance(value, str) else column(value))


def _frame(value: Any) -> DataFrame | None:
    if isinstance(value, DataFrame):
        return value
    if isinstance(value, (Expr, Column)):  # a column has any attribute
        return None
    return value.to_df() if hasattr(value, "to_df") else None


class Expr:
    """A column with the comparison, scalar and aggregate vocabulary of the query layer. ``kind``: its type, where known."""

    def __init__(self, col: Column, kind: str | None = None):
        self.column, self.kind = col, kind

    # comparisons
    def eq(self, other) -> Expr:
        """Null means IS NULL, a list means IN, a query means a scalar subquery."""
        if other is None:
            return self.is_null()
        if isinstance(other, (list, tuple, set)):
            return self.in_(other)
        return Expr(self.column == self._other(other))

    def neq(self, other) -> Expr:
        if other is None:
            return self.is_not_null()
        if isinstance(other, (list, tuple, set)):
            return self.not_in(other)
        return Expr(self.column != self._other(other))

    ne = neq

    def _other(self, value) -> Column:
        frame = _frame(value)
        return frame.scalar() if frame is not None else column(value)

    def gt(self, other) -> Expr:
        return Expr(self.column > self._other(other))

    def gte(self, other) -> Expr:
        return Expr(self.column >= self._other(other))

    def lt(self, other) -> Expr:
        return Expr(self.column < self._other(other))

    def lte(self, other) -> Expr:
        return Expr(self.column <= self._other(other))

    def between(self, low, high) -> Expr:
        return Expr(self.column.between(column(low), column(high)))

    def not_between(self, low, high) -> Expr:
        return Expr(~self.column.between(column(low), column(high)))

    def in_(self, values) -> Expr:
        """Member of a list; the empty list holds nothing. Subqueries go through SelectQuery.where_in_subquery."""
        values = [column(v) for v in values]
        return Expr(self.column.isin(*values)) if values else Expr(F.lit(False))

    def not_in(self, values) -> Expr:
        values = [column(v) for v in values]
        return Expr(~self.column.isin(*values)) if values else Expr(F.lit(True))

    def is_null(self) -> Expr:
        return Expr(self.column.isNull())

    def is_not_null(self) -> Expr:
        return Expr(self.column.isNotNull())

    def like(self, pattern: str) -> Expr:
        return Expr(self.column.like(pattern))

    def not_like(self, pattern: str) -> Expr:
        return Expr(~self.column.like(pattern))

    def ilike(self, pattern: str) -> Expr:
        return Expr(self.column.ilike(pattern))

    like_ignore_case = ilike

    def starts_with(self, text: str) -> Expr:
        return Expr(self.column.startswith(text))

    def ends_with(self, text: str) -> Expr:
        return Expr(self.column.endswith(text))

    def contains(self, text: str) -> Expr:
        return Expr(self.column.contains(text))

    def equals_ignore_case(self, text) -> Expr:
        return Expr(F.lower(self.column) == F.lower(column(text)))

    def starts_with_ignore_case(self, text: str) -> Expr:
        return Expr(F.lower(self.column).startswith(text.lower()))

    def ends_with_ignore_case(self, text: str) -> Expr:
        return Expr(F.lower(self.column).endswith(text.lower()))

    def contains_ignore_case(self, text: str) -> Expr:
        return Expr(F.lower(self.column).contains(text.lower()))

    def matches(self, pattern: str | re.Pattern, flags: str = "") -> Expr:
        """Regular expression; the flags i, m and s of a compiled pattern carry over."""
        if isinstance(pattern, re.Pattern):
            flags = "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & f)
            pattern = pattern.pattern
        return Expr(self.column.rlike(f"(?{flags}){pattern}" if flags else pattern))

    def match_against(self, query: str, any_word: bool = False) -> Expr:
        """Full-text match on whole lower-cased words, all of them or any; there is no stemming."""
        wanted = sorted({w for w in re.split(r"\W+", query.lower()) if w})
        words = F.split(F.lower(self.column), r"[^\p{L}\p{N}_]+")
        if not wanted:
            return Expr(F.lit(False))
        asked = F.array(*map(F.lit, wanted))
        return Expr(F.arrays_overlap(words, asked) if any_word else F.size(F.array_except(asked, words)) == 0)

    # arrays
    def array_contains(self, values: Iterable) -> Expr:
        return Expr(F.size(F.array_except(_array(values, self.column), self.column)) == 0)

    def array_overlaps(self, values: Iterable) -> Expr:
        return Expr(F.arrays_overlap(self.column, _array(values, self.column)))

    def array_contained_by(self, values: Iterable) -> Expr:
        return Expr(F.size(F.array_except(self.column, _array(values, self.column))) == 0)

    # logic
    def and_(self, *others) -> Expr:
        return and_(self, *others)

    def or_(self, *others) -> Expr:
        return or_(self, *others)

    def not_(self) -> Expr:
        return Expr(~self.column)

    # strings
    def to_lower_case(self) -> Expr:
        return Expr(F.lower(self.column))

    def to_upper_case(self) -> Expr:
        return Expr(F.upper(self.column))

    def trim(self) -> Expr:
        return Expr(F.trim(self.column))

    def length(self) -> Expr:
        return Expr(F.char_length(self.column), "int")

    def substring(self, start: int, end: int | None = None) -> Expr:
        """From ``start`` (0-based) up to ``end``, which is left out."""
        if start < 0 or end is not None and end < start:
            raise ValueError("substring takes 0 <= start <= end")
        rest = (F.lit(start + 1),) if end is None else (F.lit(start + 1), F.lit(end - start))
        return Expr(F.substr(self.column, *rest))

    def concat(self, *others) -> Expr:
        """Null counts as the empty text."""
        return Expr(F.concat_ws("", self.column, *[column(o) for o in others]))

    def index_of(self, text) -> Expr:
        """0-based; -1 where absent."""
        return Expr(F.locate(text, self.column) - 1 if isinstance(text, str) else F.position(column(text), self.column) - 1, "int")

    def replace(self, old, new) -> Expr:
        return Expr(F.replace(self.column, column(old), column(new)))

    # casts
    def cast(self, kind: str) -> Expr:
        return Expr(self.column.cast(kind), kind)

    def string_value(self) -> Expr:
        return self.cast("string")

    def int_value(self) -> Expr:
        return self.cast("int")

    def long_value(self) -> Expr:
        return self.cast("bigint")

    bigint_value = long_value

    def float_value(self) -> Expr:
        return self.cast("float")

    def double_value(self) -> Expr:
        return self.cast("double")

    def boolean_value(self) -> Expr:
        return self.cast("boolean")

    # numbers
    def _kind_with(self, other) -> str | None:
        kinds = {self.kind, other.kind if isinstance(other, Expr) else "int" if type(other) is int else None}
        return self.kind if kinds <= INTEGRAL else None

    def add(self, other) -> Expr:
        return Expr(self.column + column(other), self._kind_with(other))

    def sub(self, other) -> Expr:
        return Expr(self.column - column(other), self._kind_with(other))

    def mul(self, other) -> Expr:
        return Expr(self.column * column(other), self._kind_with(other))

    def div(self, other) -> Expr:
        """Between integers the quotient without its fraction, else the true quotient."""
        if self._kind_with(other):
            return Expr(F.call_function("div", self.column, column(other)), "bigint")
        return Expr(self.column / column(other))

    def mod(self, other) -> Expr:
        """The sign is that of the dividend."""
        return Expr(self.column % column(other), self._kind_with(other))

    def neg(self) -> Expr:
        return Expr(-self.column, self.kind)

    def abs(self) -> Expr:
        return Expr(F.abs(self.column), self.kind)

    def floor(self) -> Expr:
        return Expr(F.floor(self.column))

    def ceil(self) -> Expr:
        return Expr(F.ceil(self.column))

    def round(self, digits: int = 0) -> Expr:
        return Expr(F.round(self.column, digits))

    def sqrt(self) -> Expr:
        return Expr(F.sqrt(self.column))

    # nulls
    def coalesce(self, *others) -> Expr:
        return coalesce(self, *others)

    def nullif(self, other) -> Expr:
        return Expr(F.nullif(self.column, column(other)), self.kind)

    def greatest(self, *others) -> Expr:
        return greatest(self, *others)

    def least(self, *others) -> Expr:
        return least(self, *others)

    # dates
    def year(self) -> Expr:
        return Expr(F.year(self.column), "int")

    def month(self) -> Expr:
        return Expr(F.month(self.column), "int")

    def day(self) -> Expr:
        return Expr(F.dayofmonth(self.column), "int")

    day_of_month = day

    def hour(self) -> Expr:
        return Expr(F.hour(self.column), "int")

    def minute(self) -> Expr:
        return Expr(F.minute(self.column), "int")

    def second(self) -> Expr:
        return Expr(F.second(self.column), "int")

    def day_of_week(self) -> Expr:
        """Sunday is 0."""
        return Expr(F.dayofweek(self.column) - 1, "int")

    def day_of_year(self) -> Expr:
        return Expr(F.dayofyear(self.column), "int")

    def week(self) -> Expr:
        """ISO week."""
        return Expr(F.weekofyear(self.column), "int")

    def quarter(self) -> Expr:
        return Expr(F.quarter(self.column), "int")

    def _plus(self, unit: str, n) -> Expr:
        return Expr(F.timestamp_add(unit, column(n), self.column))

    def add_years(self, n) -> Expr:
        return self._plus("YEAR", n)

    def add_months(self, n) -> Expr:
        """Stays within the target month."""
        return self._plus("MONTH", n)

    def add_days(self, n) -> Expr:
        return self._plus("DAY", n)

    def add_hours(self, n) -> Expr:
        return self._plus("HOUR", n)

    def add_minutes(self, n) -> Expr:
        return self._plus("MINUTE", n)

    def add_seconds(self, n) -> Expr:
        return self._plus("SECOND", n)

    # aggregates
    def count(self) -> Agg:
        return Agg("count", self.column)

    def count_distinct(self) -> Agg:
        return Agg("count", self.column, distinct=True)

    def sum(self) -> Agg:
        return Agg("sum", self.column)

    def avg(self) -> Agg:
        return Agg("avg", self.column)

    def min(self) -> Agg:
        return Agg("min", self.column)

    def max(self) -> Agg:
        return Agg("max", self.column)

    def count_if(self, condition) -> Agg:
        return Agg("count", self.column).filter(condition)

    def sum_if(self, condition) -> Agg:
        return Agg("sum", self.column).filter(condition)

    # order and names
    def asc(self) -> Order:
        return Order(self.column, False)

    def desc(self) -> Order:
        return Order(self.column, True)

    def as_(self, name: str) -> Expr:
        return Expr(self.column.alias(name), self.kind)

    alias = as_

    def over(self, window) -> Expr:
        return Expr(self.column.over(window.spec if isinstance(window, WindowBuilder) else window))


def _array(values: Iterable, like: Column) -> Column:
    if isinstance(values, (Expr, Column)):
        return column(values)
    found = [column(v) for v in values]
    return F.array(*found) if found else F.slice(like, 1, 0)


class Order:
    """A sort key; nulls come last ascending and first descending unless told otherwise."""

    def __init__(self, col: Column, down: bool, nulls_first: bool | None = None, name: str | None = None):
        self.col, self.down, self.name = col, down, name
        self.first = down if nulls_first is None else nulls_first

    def nulls_first(self) -> Order:
        return Order(self.col, self.down, True, self.name)

    def nulls_last(self) -> Order:
        return Order(self.col, self.down, False, self.name)

    @property
    def column(self) -> Column:
        names = {(False, False): "asc_nulls_last", (False, True): "asc_nulls_first", (True, False): "desc_nulls_last", (True, True): "desc_nulls_first"}
        return getattr(self.col, names[self.down, self.first])()


def order_of(key) -> Order:
    """An Order, an expression or name (ascending), or a pair (name, "asc" or "desc")."""
    if isinstance(key, Order):
        return key
    if isinstance(key, tuple):
        name, way = key
        if str(way).lower() not in ("asc", "desc"):
            raise ValueError(f"unknown direction {way!r}")
        return Order(as_expr(name).column, str(way).lower() == "desc", name=name if isinstance(name, str) else None)
    return Order(as_expr(key).column, False, name=key if isinstance(key, str) else None)


class Agg(Expr):
    """count, sum, avg, min or max of an expression, with DISTINCT and FILTER; also usable over a window."""

    NAMES = {"count", "sum", "avg", "min", "max"}

    def __init__(self, name: str, arg: Column, distinct: bool = False, where: Column | None = None):
        if name not in self.NAMES:
            raise ValueError(f"unknown aggregate {name!r}")
        self.name, self.arg, self.distinct_, self.where = name, arg, distinct, where
        value = arg if where is None else F.when(where, arg)
        plain = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name]
        unique = {"count": F.count_distinct, "sum": F.sum_distinct, "avg": lambda c: F.sum_distinct(c) / F.count_distinct(c)}.get(name, plain)
        super().__init__((unique if distinct else plain)(value), "bigint" if name == "count" else None)

    def filter(self, condition) -> Agg:
        """FILTER (WHERE ...); a further call narrows it."""
        c = column(condition)
        return Agg(self.name, self.arg, self.distinct_, c if self.where is None else self.where & c)

    def distinct(self) -> Agg:
        return Agg(self.name, self.arg, True, self.where)


def aggregate(name: str, arg="*", distinct: bool = False) -> Agg:
    return Agg(name, F.lit(1) if isinstance(arg, str) and arg == "*" else as_expr(arg).column, distinct)


def count(arg="*") -> Agg:
    return aggregate("count", arg)


def sum_(arg) -> Agg:
    return aggregate("sum", arg)


def avg(arg) -> Agg:
    return aggregate("avg", arg)


def min_(arg) -> Agg:
    return aggregate("min", arg)


def max_(arg) -> Agg:
    return aggregate("max", arg)


class OrderedSets(Expr):
    """An expression over ordered-set aggregates. ``rebuilt`` makes it again over other columns for these, so that they can be worked out apart."""

    def __init__(self, made: Expr, sets: list[OrderedSet], rebuilt: Callable[[dict], Expr]):
        super().__init__(made.column, made.kind)
        self.sets, self.rebuilt = sets, rebuilt


def _chained(method: Callable) -> Callable:
    """A method of Expr on OrderedSets, which stays one."""

    @functools.wraps(method)
    def call(self, *args, **named):
        given = [*args, *named.values()]
        made = method(Expr(self.column, self.kind), *args, **named)
        if not isinstance(made, Expr):
            return made
        put = lambda x, values: x.rebuilt(values) if isinstance(x, OrderedSets) else x
        again = lambda values: method(self.rebuilt(values), *[put(x, values) for x in args], **{k: put(x, values) for k, x in named.items()})
        return OrderedSets(made, [s for x in (self, *given) if isinstance(x, OrderedSets) for s in x.sets], again)

    return call


for _name, _method in list(vars(Expr).items()):
    if callable(_method) and not _name.startswith("_"):
        setattr(OrderedSets, _name, _chained(_method))


class OrderedSet(OrderedSets):
    """percentile_cont, percentile_disc or mode, WITHIN GROUP (ORDER BY a column name or SQL expression)."""

    def __init__(self, name: str, arg: str, fraction: float | None = None, way: str = "ASC"):
        if fraction is not None and not 0 <= fraction <= 1:
            raise ValueError("the fraction lies between 0 and 1")
        self.parts, self.way = (name, arg, fraction), way
        # of equally frequent values, mode takes the first in the order
        made = Expr(F.expr(f"{name}({'' if fraction is None else float(fraction)}) WITHIN GROUP (ORDER BY {arg} {way})"))
        super().__init__(made, [self], lambda values: Expr(values[self]))

    def asc(self) -> OrderedSet:
        return OrderedSet(*self.parts)

    def desc(self) -> OrderedSet:
        return OrderedSet(*self.parts, way="DESC")


def percentile_cont(fraction: float, arg: str) -> OrderedSet:
    return OrderedSet("percentile_cont", arg, fraction)


def percentile_disc(fraction: float, arg: str) -> OrderedSet:
    return OrderedSet("percentile_disc", arg, fraction)


def mode(arg: str) -> OrderedSet:
    return OrderedSet("mode", arg)


# windows


class WindowBuilder:
    """partition_by, order_by, rows_between and range_between, as of one OVER clause. Explicit null places are honoured."""

    def __init__(self, spec: WindowSpec | None = None):
        self.spec = spec or Window.partitionBy()

    def partition_by(self, *keys) -> WindowBuilder:
        return WindowBuilder(self.spec.partitionBy(*[as_expr(k).column for k in keys]))

    def order_by(self, *keys) -> WindowBuilder:
        return WindowBuilder(self.spec.orderBy(*[order_of(k).column for k in keys]))

    @staticmethod
    def _bound(text) -> int:
        """An offset, or frame words such as "2 PRECEDING", "CURRENT ROW", "UNBOUNDED FOLLOWING"."""
        if isinstance(text, int):
            return text
        words = text.upper().split()
        if words == ["CURRENT", "ROW"]:
            return Window.currentRow
        if len(words) == 2 and words[1] in ("PRECEDING", "FOLLOWING"):
            if words[0] == "UNBOUNDED":
                return Window.unboundedPreceding if words[1] == "PRECEDING" else Window.unboundedFollowing
            return int(words[0]) * (-1 if words[1] == "PRECEDING" else 1)
        raise ValueError(f"unknown frame bound {text!r}")

    def rows_between(self, low, high) -> WindowBuilder:
        return WindowBuilder(self.spec.rowsBetween(self._bound(low), self._bound(high)))

    def range_between(self, low, high) -> WindowBuilder:
        return WindowBuilder(self.spec.rangeBetween(self._bound(low), self._bound(high)))


def window() -> WindowBuilder:
    return WindowBuilder()


def row_number() -> Expr:
    return Expr(F.row_number(), "int")


def rank() -> Expr:
    return Expr(F.rank(), "int")


def dense_rank() -> Expr:
    return Expr(F.dense_rank(), "int")


def ntile(n: int) -> Expr:
    if n < 1:
        raise ValueError("ntile takes a positive number")
    return Expr(F.ntile(n), "int")


def percent_rank() -> Expr:
    return Expr(F.percent_rank())


def cume_dist() -> Expr:
    return Expr(F.cume_dist())


def lag(arg, offset: int = 1, default=None) -> Expr:
    return Expr(F.lag(as_expr(arg).column, offset, default))


def lead(arg, offset: int = 1, default=None) -> Expr:
    return Expr(F.lead(as_expr(arg).column, offset, default))


def first_value(arg) -> Expr:
    return Expr(F.first_value(as_expr(arg).column))


def last_value(arg) -> Expr:
    """With the default frame this is the last row up to the current one."""
    return Expr(F.last_value(as_expr(arg).column))


def nth_value(arg, n: int) -> Expr:
    if n < 1:
        raise ValueError("nth_value counts from 1")
    return Expr(F.nth_value(as_expr(arg).column, n))


# logic, nulls, cases


def col(name: str, kind: str | None = None) -> Expr:
    return Expr(F.col(name), kind)


ref = col


def lit(value) -> Expr:
    return Expr(F.lit(value), "int" if type(value) is int else None)


def raw_expr(text: str) -> Expr:
    return Expr(F.expr(text))


def and_(*conditions) -> Expr:
    out = F.lit(True)
    for i, c in enumerate(conditions):
        out = column(c) if i == 0 else out & column(c)
    return Expr(out)


def or_(*conditions) -> Expr:
    out = F.lit(False)
    for i, c in enumerate(conditions):
        out = column(c) if i == 0 else out | column(c)
    return Expr(out)


def not_(condition) -> Expr:
    return Expr(~column(condition))


def coalesce(*args) -> Expr:
    if len(args) < 2:
        raise ValueError("coalesce takes two values or more")
    return Expr(F.coalesce(*[column(a) for a in args]))


def nullif(a, b) -> Expr:
    return Expr(F.nullif(column(a), column(b)))


def greatest(*args) -> Expr:
    """Nulls are passed over."""
    if len(args) < 2:
        raise ValueError("greatest takes two values or more")
    return Expr(F.greatest(*[column(a) for a in args]))


def least(*args) -> Expr:
    if len(args) < 2:
        raise ValueError("least takes two values or more")
    return Expr(F.least(*[column(a) for a in args]))


def random(seed: int | None = None) -> Expr:
    return Expr(F.rand(seed))


class Case:
    """when(condition).then(value) ... otherwise(value); with a subject, when(value) compares it."""

    def __init__(self, subject=None):
        self.subject, self.arms, self.rest, self.open = subject, [], None, None

    def when(self, condition) -> Case:
        if self.open is not None:
            raise ValueError("when() must be followed by then()")
        self.open = condition
        return self

    def then(self, value) -> Case:
        if self.open is None:
            raise ValueError("then() must follow when()")
        test = column(self.open) if self.subject is None else as_expr(self.subject).column == column(self.open)
        self.arms.append((test, column(value)))
        self.open = None
        return self

    def otherwise(self, value) -> Case:
        self.rest = column(value)
        return self

    def end(self) -> Expr:
        if not self.arms:
            raise ValueError("a case needs one when() at least")
        out = F
        for test, value in self.arms:
            out = out.when(test, value)
        return Expr(out if self.rest is None else out.otherwise(self.rest))


def case(subject=None) -> Case:
    return Case(subject)


def iff(condition, yes, no) -> Expr:
    return Expr(F.when(column(condition), column(yes)).otherwise(column(no)))


def map_values(subject, mapping: dict, default=None) -> Expr:
    made = Case(subject)
    for key, value in mapping.items():
        made.when(key).then(value)
    return made.otherwise(default).end()


def buckets(subject, thresholds: list[tuple[Any, Any]], default=None, op: str = ">=") -> Expr:
    """The value of the first (threshold, value) that holds."""
    compare = {">=": Expr.gte, ">": Expr.gt, "<=": Expr.lte, "<": Expr.lt}[op]
    made = Case()
    for bound, value in thresholds:
        made.when(compare(as_expr(subject), bound)).then(value)
    return made.otherwise(default).end()


class TupleExpr:
    """(a, b) IN ((..), (..)); the empty list holds nothing."""

    def __init__(self, *parts):
        self.parts = [as_expr(p).column for p in parts]

    def _row(self, values) -> Column:
        values = tuple(values)
        if len(values) != len(self.parts):
            raise ValueError(f"{len(self.parts)} values are needed, not {len(values)}")
        out = F.lit(True)
        for c, v in zip(self.parts, values, strict=True):
            out = out & (c == column(v))
        return out

    def eq(self, values) -> Expr:
        return Expr(self._row(values))

    def in_(self, rows) -> Expr:
        return or_(*[self._row(r) for r in rows])

    def not_in(self, rows) -> Expr:
        rows = [self._row(r) for r in rows]
        return not_(or_(*rows)) if rows else Expr(F.lit(True))


def tuple_(*parts) -> TupleExpr:
    return TupleExpr(*parts)


# dates


def current_date() -> Expr:
    return Expr(F.current_date())


def current_time() -> Expr:
    return Expr(F.current_time())


def current_timestamp() -> Expr:
    return Expr(F.current_timestamp())


UNITS = {"year", "quarter", "month", "week", "day", "hour", "minute", "second"}


def _unit(unit: str) -> str:
    if unit.lower() not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    return unit.upper()


def date_diff(unit: str, a, b) -> Expr:
    """a - b in whole units, without the fraction."""
    return Expr(F.timestamp_diff(_unit(unit), as_expr(b).column, as_expr(a).column), "bigint")


def date_trunc(unit: str, a) -> Expr:
    """Weeks start on Monday. The result has no time zone."""
    return Expr(F.date_trunc(_unit(unit), as_expr(a).column).cast("timestamp_ntz"))


# JSON


def parse_json_path(path: str) -> list[str | int]:
    """``a.b[0]["k"]`` -> its segments."""
    out: list[str | int] = []
    at = 0
    step = re.compile(r"""\.?([^.\[\]"']+)|\[(\d+)\]|\[(?:"([^"]*)"|'([^']*)')\]""")
    while at < len(path):
        m = step.match(path, at)
        if not m:
            raise ValueError(f"bad JSON path {path!r}")
        out.append(int(m[2]) if m[2] is not None else next(x for x in (m[1], m[3], m[4]) if x is not None))
        at = m.end()
    return out


class Json(Expr):
    """A place in a JSON text. Comparisons take the type of the value compared with."""

    def __init__(self, source, segments: list[str | int] | None = None):
        self.source, self.segments = as_expr(source).column, segments or []
        super().__init__(F.get_json_object(self.source, self._path()))

    def _path(self) -> str:
        return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in self.segments)

    def path(self, text: str) -> Json:
        return Json(self.source, self.segments + parse_json_path(text))

    def __getattr__(self, name: str) -> Json:
        if name.startswith("_"):
            raise AttributeError(name)
        return Json(self.source, [*self.segments, name])

    def __getitem__(self, key: str | int) -> Json:
        return Json(self.source, [*self.segments, key])

    def _typed(self, value) -> Expr:
        if isinstance(value, bool):
            return Expr(self.column.try_cast("boolean"))
        if isinstance(value, (int, float)):
            return Expr(self.column.try_cast("double"))
        return Expr(self.column)

    def eq(self, other) -> Expr:
        return Expr.eq(self._typed(_sample(other)), other)

    def neq(self, other) -> Expr:
        return Expr.neq(self._typed(_sample(other)), other)

    ne = neq

    def gt(self, other) -> Expr:
        return Expr.gt(self._typed(other), other)

    def gte(self, other) -> Expr:
        return Expr.gte(self._typed(other), other)

    def lt(self, other) -> Expr:
        return Expr.lt(self._typed(other), other)

    def lte(self, other) -> Expr:
        return Expr.lte(self._typed(other), other)

    def between(self, low, high) -> Expr:
        return Expr.between(self._typed(low), low, high)

    def in_(self, values) -> Expr:
        return Expr.in_(self._typed(_sample(values)), values)

    def not_in(self, values) -> Expr:
        return Expr.not_in(self._typed(_sample(values)), values)

    def contains(self, value) -> Expr:
        """Containment: objects by their keys, arrays by their elements, scalars by equality or as an element."""
        return Expr(F.coalesce(_holds(self.column, value), F.lit(False)))

    def has_key(self, key: str) -> Expr:
        """The key is there, even with the value null."""
        return Expr(F.coalesce(F.array_contains(F.json_object_keys(self.column), key), F.lit(False)))

    def array_length(self) -> Expr:
        return Expr(F.json_array_length(self.column), "int")

    def type_of(self) -> Expr:
        """object, array, string, number, boolean or null; none where nothing is there."""
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(self.source), self._path(), "variant"))
        return Expr(
            F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
            .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
        )


def _sample(value):
    return next(iter(value), None) if isinstance(value, (list, tuple, set)) else value


def _holds(text: Column, value) -> Column:
    """Containment in a JSON text, which each level parses once: objects as maps, arrays as lists, of texts."""
    if isinstance(value, dict):
        own = F.from_json(text, "map<string,string>")
        # a key that must be null says nothing about whether this is an object; other keys do, and spare a second parse
        parts = [_holds(own.getItem(k), v) for k, v in value.items()]
        return _all([own.isNotNull(), *parts] if not parts or None in value.values() else parts)
    elements = F.from_json(text, "array<string>")
    if isinstance(value, (list, tuple)):
        parts = [F.exists(elements, _within(v)) if isinstance(v, (dict, list, tuple)) else _element(elements, v) for v in value]
        return _all(parts or [elements.isNotNull()])
    return F.coalesce(_element(elements, value), F.lit(False)) | F.coalesce(_scalar(text, value), F.lit(False))


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _scalar(text: Column, value) -> Column:
    if isinstance(value, bool):
        return text == json.dumps(value)
    if isinstance(value, (int, float)):
        return text.try_cast("double") == float(value)
    return text.isNull() if value is None else text == value


def _element(elements: Column, value) -> Column:
    return F.exists(elements, lambda e: F.coalesce(_scalar(e, value), F.lit(False)))


def json_path(source, path: str = "") -> Json:
    return Json(source, parse_json_path(path))


def _within(value):
    return lambda e: F.coalesce(_holds(e, value), F.lit(False))
