"""Keyset pages: no offsets, a cursor of (sort value, id), one row of look-ahead."""

from __future__ import annotations

import base64
import binascii
import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions.data import to_base64url

DEFAULT, MOST = 200, 200


def limit(asked: object, default: int = DEFAULT, most: int = MOST) -> int:
    """A whole number of at least 1, at most ``most``; anything else is the default."""
    text = str(asked).strip() if asked is not None else ""
    return min(int(text), most) if text.isascii() and text.isdigit() and int(text) >= 1 else min(default, most)


def encode_cursor(value: datetime, id_: object) -> str:
    body = json.dumps({"v": value.isoformat(timespec="milliseconds"), "id": id_}, separators=(",", ":"))
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def cursor_column(value: Column, id_: Column) -> Column:
    """``encode_cursor`` for every row: value is a moment, id_ a whole number."""
    body = F.concat(F.lit('{"v":"'), F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit('","id":'), id_.cast("string"), F.lit("}"))
    return to_base64url(body)


def decode_cursor(text: str | None) -> tuple[datetime, object] | None:
    """None unless it is whole: an object with a date and an id."""
    if not text:
        return None
    try:
        body = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        return (datetime.fromisoformat(body["v"]), body["id"]) if body["id"] not in (None, "") else None
    except (ValueError, KeyError, TypeError, binascii.Error):
        return None


def after(key: str, id_: str, cursor: tuple | None, ascending: bool = False) -> Column | None:
    """Rows past the cursor: the sort value is beyond it, or equal with the id beyond."""
    if cursor is None:
        return None
    v, i = F.lit(cursor[0]).cast("timestamp_ntz"), F.lit(cursor[1])
    k, n = F.col(key), F.col(id_)
    return (k > v) | ((k == v) & (n > i)) if ascending else (k < v) | ((k == v) & (n < i))


def window(df: DataFrame, size: int, key: str = "created_at", id_: str = "id", cursor: tuple | None = None, ascending: bool = False) -> DataFrame:
    """size + 1 rows of the page; planned as a top-k, never a full sort."""
    past = after(key, id_, cursor, ascending)
    order = [F.col(key).asc_nulls_last(), F.col(id_).asc()] if ascending else [F.col(key).desc_nulls_last(), F.col(id_).desc()]
    return (df if past is None else df.where(past)).orderBy(*order).limit(size + 1)


@dataclass
class Page:
    rows: list[Row]
    more: bool
    cursor: str | None
    total: int | None


def page(df: DataFrame, size: int, key: str = "created_at", id_: str = "id", cursor: str | None = None, ascending: bool = False, count: bool = False) -> Page:
    """One page on the driver (at most ``MOST`` rows). The total is counted on the first page only and ignores the cursor."""
    at = decode_cursor(cursor)
    rows = window(df, size, key, id_, at, ascending).collect()
    kept, more = rows[:size], len(rows) > size
    total = df.count() if count and at is None else None
    return Page(kept, more, encode_cursor(kept[-1][key], kept[-1][id_]) if more else None, total)


def headers(p: Page) -> dict[str, str]:
    out = {"X-Has-More": str(p.more).lower()}
    if p.cursor:
        out["X-Next-Cursor"] = p.cursor
    if p.total is not None:
        out["X-Total-Count"] = str(p.total)
    return out
