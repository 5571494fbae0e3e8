"""Pages by number and by cursor."""

from __future__ import annotations

import base64
import datetime
import decimal
import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.errors import InvalidQuery
from quillspark.functions.expr import Order

DEFAULT_SIZE = 20


@dataclass
class Page:
    data: list[dict]
    total: int
    page: int
    page_size: int

    @property
    def total_pages(self) -> int:
        return -(-self.total // self.page_size)

    @property
    def has_next_page(self) -> bool:
        return self.page < self.total_pages

    @property
    def has_previous_page(self) -> bool:
        return self.page > 1


@dataclass
class CursorPage:
    data: list[dict]
    next_cursor: str | None
    has_next_page: bool


def normal_page(page) -> int:
    return max(1, int(page or 1))


def normal_size(size) -> int:
    return int(size) if size and int(size) > 0 else DEFAULT_SIZE


def page(query, number: int, size: int) -> Page:
    number, size = normal_page(number), normal_size(size)
    rows = query.offset((number - 1) * size).limit(size).get_many()
    return Page(rows, query.get_count(), number, size)


def encode_cursor(values: list) -> str:
    """URL-safe text of sort key values, types kept."""

    def tagged(v):
        if isinstance(v, (datetime.datetime, datetime.date)):
            return {"$date" if not isinstance(v, datetime.datetime) else "$time": v.isoformat()}
        if isinstance(v, decimal.Decimal):
            return {"$decimal": str(v)}
        return {"$bigint": str(v)} if isinstance(v, int) and not isinstance(v, bool) and abs(v) >= 1 << 53 else v

    return base64.urlsafe_b64encode(json.dumps([tagged(v) for v in values]).encode()).decode()


def decode_cursor(text: str) -> list | None:
    """None where the text is no cursor."""
    kinds = {"$date": datetime.date.fromisoformat, "$time": datetime.datetime.fromisoformat, "$decimal": decimal.Decimal, "$bigint": int}
    try:
        found = json.loads(base64.urlsafe_b64decode(text.encode()))
        if not isinstance(found, list):
            return None
        return [kinds[k](next(iter(v.values()))) if isinstance(v, dict) and (k := next(iter(v))) in kinds else v for v in found]
    except (ValueError, KeyError, StopIteration):
        return None


def after_cursor(order: list[tuple[str, bool]], values: list) -> Column:
    """Rows behind ``values`` in the order of (name, descending) keys; nulls stand last ascending and first descending."""
    out = F.lit(False)
    same = F.lit(True)
    for (name, down), v in zip(order, values, strict=True):
        c = F.col(name)
        if v is None:
            behind = c.isNotNull() if down else F.lit(False)
            equal = c.isNull()
        else:
            behind = c < F.lit(v) if down else (c > F.lit(v)) | c.isNull()
            equal = c == F.lit(v)
        out = out | (same & behind)
        same = same & equal
    return F.coalesce(out, F.lit(False))


def keyset(query) -> list[tuple[str, bool]]:
    """Sort keys of a query by name, with the primary key behind them to make the order total."""
    names = []
    for o in query.order:
        if o.name is None:
            raise InvalidQuery("a cursor page is ordered by names")
        names.append((o.name, o.down))
    known = {n for n, _ in names}
    if query.entity is None and not names:
        raise InvalidQuery("a cursor needs an order")
    down = bool(names and names[0][1])
    return names + [(k, down) for k in (query.entity.key if query.entity else []) if k not in known]


def cursor_page(query, take: int, after: str | None) -> CursorPage:
    """Fetches one row more than asked for, which tells whether a page follows. A malformed cursor is an error."""
    take = normal_size(take)
    keys = keyset(query)
    ordered = query.order_by(*[Order(F.col(n), d) for n, d in keys])
    if after is not None:
        values = decode_cursor(after)
        if values is None or len(values) != len(keys):
            raise InvalidQuery("malformed cursor")
        ordered = ordered.where(after_cursor(keys, values))
    rows = ordered.limit(take + 1).get_many()
    more = len(rows) > take
    rows = rows[:take]
    return CursorPage(rows, encode_cursor([rows[-1][n] for n, _ in keys]) if more else None, more)

