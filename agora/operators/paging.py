"""Keyset and offset pages."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after(cursor: Sequence[tuple[str, object, bool]]) -> Column:
    """Rows that come after a cursor of (column, value, descending), most significant first."""
    parts, equal = [], F.lit(True)
    for name, value, descending in cursor:
        literal = F.lit(value)
        parts.append(equal & (F.col(name) < literal if descending else F.col(name) > literal))
        equal = equal & (F.col(name) == literal)
    return reduce(lambda a, b: a | b, parts)


def keyset_page(df: DataFrame, order: Sequence[tuple[str, bool]], size: int, cursor: Sequence[object] | None = None) -> DataFrame:
    """The next ``size`` rows in ``order`` (column, descending) and one to look ahead; a top-k, not a sort of the table."""
    if cursor is not None:
        df = df.where(after([(name, value, down) for (name, down), value in zip(order, cursor)]))
    return df.orderBy(*[F.col(n).desc() if down else F.col(n).asc() for n, down in order]).limit(size + 1)


def offset_page(df: DataFrame, order: Sequence[Column], size: int, page: int) -> DataFrame:
    return df.orderBy(*order).offset(size * page).limit(size)


def _scope(filters: Mapping[str, object], order: Sequence[tuple[str, bool]]) -> str:
    return hashlib.sha256(json.dumps([sorted(filters.items()), list(order)], default=str).encode()).hexdigest()[:16]


def encode_cursor(values: Sequence[object], filters: Mapping[str, object], order: Sequence[tuple[str, bool]]) -> str:
    """Opaque, URL-safe text of a place in an order; it holds for one filter and order only."""
    plain = [{"at": v.isoformat()} if isinstance(v, datetime) else v for v in values]
    return base64.urlsafe_b64encode(json.dumps([_scope(filters, order), plain]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, filters: Mapping[str, object], order: Sequence[tuple[str, bool]]) -> list[object]:
    """The values in a cursor; a text that is no cursor, or one of another filter or order, is an error."""
    try:
        if len(cursor) > 600:
            raise ValueError
        scope, plain = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        if scope != _scope(filters, order) or len(plain) != len(order):
            raise ValueError
        return [datetime.fromisoformat(v["at"]) if isinstance(v, dict) else v for v in plain]
    except (ValueError, TypeError, KeyError) as e:
        raise ValueError("the cursor does not belong to this query") from e


def cursor_page(df: DataFrame, order: Sequence[tuple[str, bool]], size: int, filters: Mapping[str, object], cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """(the next ``size`` rows, the cursor after them or None); only the page itself, and one row more, is looked at."""
    found = keyset_page(df, order, size, None if cursor is None else decode_cursor(cursor, filters, order))
    ends = found.select(*[n for n, _ in order]).collect()  # size + 1 rows
    after_ = encode_cursor(list(ends[size - 1]), filters, order) if len(ends) > size else None
    return found.limit(size), after_
