"""Pages by number, and pages by cursor."""

from __future__ import annotations

import base64
import datetime
import decimal
import hashlib
import json
import math
from dataclasses import dataclass, replace
from typing import Any

from tessella.expr import Expr, Order, and_, asc, col, eq, gt, lt, or_
from tessella.plans.filters import apply_filter
from tessella.plans.query import Select


@dataclass(frozen=True)
class Page:
    items: list[dict[str, Any]]
    total_items: int
    page: int
    page_size: int

    @property
    def total_pages(self) -> int:
        return max(1, math.ceil(self.total_items / self.page_size))

    @property
    def has_next(self) -> bool:
        return self.page < self.total_pages

    @property
    def has_previous(self) -> bool:
        return self.page > 1

    def response(self) -> dict[str, Any]:
        return {"items": self.items, "totalItems": self.total_items, "page": self.page, "pageSize": self.page_size, "totalPages": self.total_pages, "hasNextPage": self.has_next, "hasPrevPage": self.has_previous}


def page_query(query: Select, page: int, page_size: int) -> Select:
    for n in (page, page_size):
        if not isinstance(n, int) or isinstance(n, bool) or n < 1:
            raise ValueError("page and page size are whole numbers from 1")
    return query.offset((page - 1) * page_size).limit(page_size)


def execute_paged(query: Select, page: int, page_size: int) -> Page:
    paged = page_query(query, page, page_size)
    return Page(paged.rows(), query.count(), page, page_size)


def execute_filtered_paged(query: Select, where: dict[str, Any] | None, page: int, page_size: int, sort: str | None = None, allowed: dict[str, Expr] | None = None) -> Page:
    """A filter, a sort term of a list of allowed ones (``-name`` for descending) and the primary key to break ties."""
    query, key = apply_filter(query, where or {}), col(f"{query.alias}.{query.definition.key}")
    if sort:
        name = sort.lstrip("-")
        if name not in (allowed or {}):
            raise ValueError(f"can't sort by {name!r}")
        query = query.order_by(Order(allowed[name], sort.startswith("-")))
    return execute_paged(query.order_by(asc(key)), page, page_size)


# cursors -------------------------------------------------------------------------------------------------------------


def _order_digest(orders: tuple[Order, ...]) -> str:
    """Stands for the terms of an order and their directions."""
    return hashlib.blake2s("\n".join(f"{'-' if o.descending else '+'}{o.term.key}" for o in orders).encode(), digest_size=6).hexdigest()


#: How values that JSON lacks are written in a cursor, by a letter.
_WRITTEN = {"t": (datetime.datetime, datetime.datetime.isoformat, datetime.datetime.fromisoformat), "d": (datetime.date, datetime.date.isoformat, datetime.date.fromisoformat), "n": (decimal.Decimal, str, decimal.Decimal)}


def _write(value: Any) -> Any:
    kind = next((k for k, (cls, _, _) in _WRITTEN.items() if isinstance(value, cls)), None)
    return value if kind is None else {kind: _WRITTEN[kind][1](value)}


def _read(value: Any) -> Any:
    if not isinstance(value, dict):
        return value
    (kind, text), = value.items()
    return _WRITTEN[kind][2](text)


def encode_cursor(values: list[Any], orders: tuple[Order, ...]) -> str:
    """An opaque text: the order's digest, then the values of its terms."""
    return base64.b32encode(json.dumps([_order_digest(orders), *map(_write, values)], separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, orders: tuple[Order, ...]) -> list[Any]:
    try:
        digest, *values = json.loads(base64.b32decode(cursor + "=" * (-len(cursor) % 8)))
        values = [_read(v) for v in values]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if digest != _order_digest(orders):
        raise ValueError("the cursor is of another order")
    return values


def keyset(orders: tuple[Order, ...], values: list[Any], backward: bool = False) -> Expr:
    """Rows after the values in the order (before them, if backward): equal in a prefix, then beyond."""
    if any(v is None for v in values):
        raise ValueError("a cursor can't hold null")
    terms = []
    for i, o in enumerate(orders):
        beyond = lt if o.descending != backward else gt
        terms.append(and_(*[eq(p.term, v) for p, v in zip(orders[:i], values, strict=False)], beyond(o.term, values[i])))
    return or_(*terms)


@dataclass(frozen=True)
class CursorPage:
    items: list[dict[str, Any]]
    has_next: bool
    has_previous: bool
    start_cursor: str | None
    end_cursor: str | None


def cursor_query(query: Select, first: int | None = None, after: str | None = None, last: int | None = None, before: str | None = None) -> Select:
    """The page's rows and one more."""
    if (first is None) == (last is None) or after is not None and last is not None or before is not None and first is not None:
        raise ValueError("give first (and after), or last (and before)")
    size, backward, cursor = first if first is not None else last, last is not None, before if last is not None else after
    if not isinstance(size, int) or size < 1:
        raise ValueError("the page size is a whole number from 1")
    if not query.orders or any(o.nulls or not o.term.key.startswith("col(") for o in query.orders):
        raise ValueError("a cursor needs an order of columns, without a place of nulls")
    if cursor is not None:
        query = query.where(keyset(query.orders, decode_cursor(cursor, query.orders), backward))
    if backward:
        query = replace(query, orders=tuple(replace(o, descending=not o.descending) for o in query.orders))
    return query.limit(size + 1)


def execute_cursor(query: Select, first: int | None = None, after: str | None = None, last: int | None = None, before: str | None = None) -> CursorPage:
    rows = cursor_query(query, first, after, last, before).rows()
    size, backward = first if first is not None else last, last is not None
    more, rows = len(rows) > size, rows[:size]
    if backward:
        rows.reverse()
    if not rows:
        return CursorPage([], False, False, None, None)
    cursor = lambda r: encode_cursor([r[o.term.name] for o in query.orders], query.orders)
    following, preceding = (before is not None, more) if backward else (more, after is not None)
    return CursorPage(rows, following, preceding, cursor(rows[0]), cursor(rows[-1]))
