"""RawQuery: SQL text put together step by step, with named parameters, common tables and set operations."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from quillspark.errors import InvalidQuery

_WINDOWED = re.compile(r"^[A-Za-z_]+\(.*\)$", re.S)


@dataclass(frozen=True)
class RawQuery:
    """Immutable. Values travel as parameter markers (``:name``), never inside the text."""

    spark: SparkSession
    select_: tuple[str, ...] = ()
    from_: str = ""
    joins: tuple[str, ...] = ()
    where_: str = ""
    group_: tuple[str, ...] = ()
    having_: str = ""
    order_: tuple[str, ...] = ()
    limit_: str = ""
    distinct_: bool = False
    on_: tuple[tuple[str, ...], tuple[str, ...]] | None = None
    tables: tuple[tuple[str, str], ...] = ()
    recursive: bool = False
    sets: tuple[tuple[str, str], ...] = ()
    suffix: str = ""
    args: tuple[tuple[str, object], ...] = ()

    def _bind(self, args: dict) -> tuple:
        return (*self.args, *args.items())

    def select(self, *items: str, **args) -> RawQuery:
        return replace(self, select_=items, args=self._bind(args))

    select_fragments = select

    def add_select_expression(self, *items: str, **args) -> RawQuery:
        return replace(self, select_=(*self.select_, *items), args=self._bind(args))

    def select_distinct(self, *items: str) -> RawQuery:
        return replace(self, select_=items, distinct_=True)

    def select_distinct_on(self, keys: list[str], items: list[str], order: list[str]) -> RawQuery:
        """The first row of each key in the order, which must be total for one answer."""
        return replace(self, select_=tuple(items), on_=(tuple(keys), tuple(order)))

    def select_with_window(self, items: list[str], windows: list[dict]) -> RawQuery:
        """windows: {expr, over, alias}; expr is one function call."""
        made = []
        for w in windows:
            if not _WINDOWED.match(w["expr"].strip()):
                raise InvalidQuery(f"not a function call: {w['expr']!r}")
            made.append(f"{w['expr']} OVER ({w['over']}) AS {w['alias']}")
        return replace(self, select_=(*items, *made))

    def from_table(self, table, alias: str = "") -> RawQuery:
        """A table name, or a query as a derived table."""
        if isinstance(table, RawQuery):
            if not alias:
                raise InvalidQuery("a derived table needs an alias")
            return replace(self, from_=f"({table.text()}) AS {alias}", args=(*self.args, *table.args))
        return replace(self, from_=f"{table} {alias}".strip())

    def join(self, kind: str, table, on: str, alias: str = "", **args) -> RawQuery:
        if kind.upper() not in ("INNER", "LEFT", "RIGHT"):
            raise InvalidQuery(f"unknown join {kind!r}")
        more = ()
        if isinstance(table, RawQuery):
            table, more = f"({table.text()})", table.args
        return replace(self, joins=(*self.joins, f"{kind.upper()} JOIN {table} {alias} ON {on}"), args=(*self._bind(args), *more))

    def inner_join(self, table, on: str, alias: str = "", **args) -> RawQuery:
        return self.join("INNER", table, on, alias, **args)

    def left_join(self, table, on: str, alias: str = "", **args) -> RawQuery:
        return self.join("LEFT", table, on, alias, **args)

    def right_join(self, table, on: str, alias: str = "", **args) -> RawQuery:
        return self.join("RIGHT", table, on, alias, **args)

    def where(self, text: str, **args) -> RawQuery:
        return replace(self, where_=f"({self.where_}) AND ({text})" if self.where_ else text, args=self._bind(args))

    and_where = where

    def or_where(self, text: str, **args) -> RawQuery:
        return replace(self, where_=f"({self.where_}) OR ({text})" if self.where_ else text, args=self._bind(args))

    def where_in(self, name: str, values: list) -> RawQuery:
        if not values:
            return self.where("1 = 0")
        keys = {f"_in{len(self.args) + i}": v for i, v in enumerate(values)}
        return self.where(f"{name} IN ({', '.join(':' + k for k in keys)})", **keys)

    def where_not_in(self, name: str, values: list) -> RawQuery:
        """An empty list adds no condition."""
        if not values:
            return self
        keys = {f"_in{len(self.args) + i}": v for i, v in enumerate(values)}
        return self.where(f"{name} NOT IN ({', '.join(':' + k for k in keys)})", **keys)

    def where_null(self, name: str) -> RawQuery:
        return self.where(f"{name} IS NULL")

    def where_not_null(self, name: str) -> RawQuery:
        return self.where(f"{name} IS NOT NULL")

    def where_between(self, name: str, low, high) -> RawQuery:
        n = len(self.args)
        return self.where(f"{name} BETWEEN :_lo{n} AND :_hi{n}", **{f"_lo{n}": low, f"_hi{n}": high})

    def where_exists(self, sub: RawQuery, negate: bool = False) -> RawQuery:
        out = self.where(f"{'NOT ' * negate}EXISTS ({sub.text()})")
        return replace(out, args=(*out.args, *sub.args))

    def where_in_query(self, name: str, sub: RawQuery, negate: bool = False) -> RawQuery:
        out = self.where(f"{name} {'NOT ' * negate}IN ({sub.text()})")
        return replace(out, args=(*out.args, *sub.args))

    def group_by(self, *keys: str) -> RawQuery:
        """Verbatim, so GROUPING SETS, ROLLUP and CUBE work."""
        return replace(self, group_=keys)

    def having(self, text: str, **args) -> RawQuery:
        return replace(self, having_=f"({self.having_}) AND ({text})" if self.having_ else text, args=self._bind(args))

    def order_by(self, *keys: str) -> RawQuery:
        return replace(self, order_=keys)

    def limit(self, n: int | list[int]) -> RawQuery:
        """A number, or [offset, number]."""
        return replace(self, limit_=f"LIMIT {int(n)}" if isinstance(n, int) else f"LIMIT {int(n[1])} OFFSET {int(n[0])}")

    def offset(self, n: int) -> RawQuery:
        return replace(self, limit_=f"{self.limit_} OFFSET {int(n)}".strip())

    def with_(self, name: str, sub: RawQuery | str, columns: str = "") -> RawQuery:
        text, args = (sub.text(), sub.args) if isinstance(sub, RawQuery) else (sub, ())
        return replace(self, tables=(*self.tables, (name + columns, text)), args=(*self.args, *args))

    def with_recursive(self, name: str, anchor: RawQuery | str, step: RawQuery | str, columns: str = "") -> RawQuery:
        parts = [x.text() if isinstance(x, RawQuery) else x for x in (anchor, step)]
        args = tuple(a for x in (anchor, step) if isinstance(x, RawQuery) for a in x.args)
        out = self.with_(name, " UNION ALL ".join(parts), columns)
        return replace(out, recursive=True, args=(*out.args, *args))

    def _set(self, word: str, other: RawQuery) -> RawQuery:
        return replace(self, sets=(*self.sets, (word, other.text())), args=(*self.args, *other.args))

    def union(self, other: RawQuery) -> RawQuery:
        return self._set("UNION", other)

    def union_all(self, other: RawQuery) -> RawQuery:
        return self._set("UNION ALL", other)

    def intersect(self, other: RawQuery) -> RawQuery:
        return self._set("INTERSECT", other)

    def except_(self, other: RawQuery) -> RawQuery:
        return self._set("EXCEPT", other)

    def append_sql(self, text: str, **args) -> RawQuery:
        return replace(self, suffix=f"{self.suffix} {text}".strip(), args=self._bind(args))

    def text(self) -> str:
        """The statement, common tables first."""
        items = ", ".join(self.select_) or "*"
        tail = [*self.joins]
        if self.where_:
            tail.append(f"WHERE {self.where_}")
        if self.group_:
            tail.append("GROUP BY " + ", ".join(self.group_))
        if self.having_:
            tail.append(f"HAVING {self.having_}")
        source = " ".join([f"FROM {self.from_}" if self.from_ else "", *tail]).strip()
        if self.on_:
            keys, order = (", ".join(x) for x in self.on_)
            core = f"SELECT * EXCEPT (__first) FROM (SELECT {items}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS __first {source}) WHERE __first = 1"
        else:
            core = f"SELECT {'DISTINCT ' * self.distinct_}{items} {source}".strip()
        for word, other in self.sets:
            core = f"({core}) {word} ({other})"
        head = ""
        if self.tables:
            head = f"WITH {'RECURSIVE ' * self.recursive}" + ", ".join(f"{n} AS ({t})" for n, t in self.tables) + " "
        order = f"ORDER BY {', '.join(self.order_)}" if self.order_ else ""
        return " ".join(x for x in (head + core, order, self.limit_, self.suffix) if x)

    def to_df(self, **values) -> DataFrame:
        """The DataFrame; ``values`` bind markers that are still open."""
        args = dict(self.args) | values
        return self.spark.sql(self.text(), args=args) if args else self.spark.sql(self.text())

    build = to_df

    def prepare(self):
        """A function of the open markers' values that runs the statement."""
        return lambda **values: [r.asDict(recursive=True) for r in self.to_df(**values).collect()]

    compile = prepare
