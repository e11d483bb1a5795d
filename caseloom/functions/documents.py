"""Document procedures that need Python: line diffs and text extraction."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import docx

DIFF = "array<struct<kind: string, text: string>>"


#: Bytes of rows that a diff keeps at a time, and places between which it computes them again.
KEPT, PLACES = 32 << 20, 64


def _row(v: int, u: int, full: int) -> int:
    """The next row of the table of common subsequences: a bit a right line, 1 where the row does not grow."""
    u &= v
    if not u:
        return v
    return ((v + u) | (v - u)) & full


def _mask(places: Sequence[int], m: int) -> int:
    if len(places) < 5:
        out = 0
        for p in places:
            out |= 1 << p
        return out
    bits = bytearray(m // 8 + 1)
    for p in places:
        bits[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(bits, "little")


def diff_backwards(left: list[str], right: list[str]) -> Iterator[tuple[str, str]]:
    """same, del and add lines by the longest common subsequence, from the last to the first.

    The walk starts at the ends of both texts; where dropping either line keeps as much, the right text's is taken
    first, so that additions come after the deletions they stand beside.  A row of the table is m bits, computed in a few
    operations on long integers.  Rows are needed from the last to the first: a stretch of rows that is too large to keep
    is divided at PLACES rows, and each part computed again, the last one first, so that some KEPT bytes are held."""
    full, m = (1 << len(right)) - 1, len(right)
    places: dict[str, list[int]] = {}
    for j, y in enumerate(right):
        places.setdefault(y, []).append(j)
    often = {y: _mask(p, m) for y, p in places.items() if len(p) * 512 > m}  # fewer than 512, so their masks can be kept

    def mask(line: str) -> int:
        return often[line] if line in often else _mask(places.get(line, ()), m)

    def rows(low: int, high: int, first: int) -> Iterator[tuple[int, int]]:
        """(i, row i) for i from high down to low; row low is ``first``."""
        few = (high - low + 1) * (m // 8 + 32) <= KEPT or high - low < PLACES
        step = 1 if few else -(-(high - low) // PLACES)
        v, held = first, [first]
        for i in range(low, high):
            v = _row(v, mask(left[i]), full)
            if (i + 1 - low) % step == 0 and i + 1 < high + few:
                held.append(v)
        if few:
            for i in range(high, low - 1, -1):
                yield i, held.pop()
            return
        for k in range(len(held) - 1, -1, -1):
            begin, end = low + k * step, min(low + (k + 1) * step, high)
            for i, row in rows(begin, end, held[k]):
                if i < end or end == high:  # (the first row of the next part is this one's last)
                    yield i, row

    j = m
    for i, row in rows(0, len(left), full):
        while True:
            if i and j and left[i - 1] == right[j - 1]:
                j -= 1
                yield "same", right[j]
                break
            if j and row >> (j - 1) & 1:
                j -= 1
                yield "add", right[j]
            elif i:
                yield "del", left[i - 1]
                break
            else:
                break


def diff_lines(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    return list(diff_backwards(left, right))[::-1]


def diffed_lines(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x.strip()]


@F.udtf(returnType="back int, kind string, line string")
class LineDiff:
    """The lines of two texts as rows, counted from the last (back 0): for a lateral join, one row at a time."""

    def eval(self, left: str, right: str):
        for k, (kind, line) in enumerate(diff_backwards(diffed_lines(left), diffed_lines(right))):
            yield k, kind, line


def line_diffs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with a row for each line of the difference of two texts: back (0 for the last line), kind and line."""
    return pairs.lateralJoin(LineDiff(F.col(left).outer(), F.col(right).outer()))


def diff(left: Column, right: Column) -> Column:
    """Of the non-blank lines of two texts."""

    @F.pandas_udf(DIFF)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "text": t} for k, t in diff_lines(diffed_lines(x), diffed_lines(y))] for x, y in zip(a, b, strict=True)])

    return run(left, right)


_DROPPED = re.compile(r"(?is)<(script|style|head|nav|footer)\b.*?</\1\s*>|<!--.*?-->")
_BREAKS = re.compile(r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>")


def html_text(page: str) -> str:
    page = _DROPPED.sub(" ", page)  # (one name, so that a step's text goes before the next step's is made)
    page = _BREAKS.sub("\n", page)
    page = re.sub(r"<[^>]+>", " ", page)
    lines = (re.sub(r"[ \t\r\f\v ]+", " ", x).strip() for m in re.finditer(r"[^\n]+", page) for x in html.unescape(m[0]).split("\n"))
    return "\n".join(x for x in lines if x)


#: Characters that a file's text has at least; names of ways to get it.
LEAST_TEXT = 20


def _extracted(kind: str, body: bytes | str | None) -> tuple[str | None, str]:
    raw = body.encode() if isinstance(body, str) else bytes(body or b"")
    if kind == "html":
        return html_text(raw.decode("utf-8", "replace")), "html"
    if kind == "docx":
        try:
            found, method = docx.text(raw).strip(), "docx"
        except docx.Oversized:
            return None, "oversized"
        except ValueError:
            return None, "unreadable"
    elif kind == "txt":
        found, method = raw.decode("utf-8", "replace").strip(), "plain-text"
    else:
        return None, "unavailable" if kind in ("pdf", "png", "jpg", "jpeg") else "refused"
    return (found, method) if len(found) >= LEAST_TEXT else (None, "too_little")


#: Bytes of results that a task holds before it hands them on.
PIECE = 1 << 20


def _pieces(rows: Iterator[tuple], make: Callable, size: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """What ``make`` gives for each row of a batch, in arrays of some PIECE bytes: of a batch's files, one at a time is held in Python."""
    made, held = [], 0
    for row in rows:
        made.append(x := make(*[c.as_py() for c in row]))
        held += size(x) + 64
        if held > PIECE:
            yield pa.array(made, kind)
            made, held = [], 0
    yield pa.array(made, kind)


def extract(kind: Column, content: Column) -> Column:
    """struct(text, method): the text of a file and how it was got.

    txt, docx and html are read here; files with less than LEAST_TEXT characters are tagged too_little, torn ones
    unreadable, oversized ones so; pdf and images need engines that are not at hand and are tagged unavailable;
    anything else is refused."""

    @F.arrow_udf("struct<text: string, method: string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        out = pa.struct({"text": pa.string(), "method": pa.string()})
        for kinds, bodies in batches:
            made = lambda k, c: dict(zip(("text", "method"), _extracted((k or "").lower(), c), strict=True))
            yield from _pieces(zip(kinds, bodies.cast(pa.large_binary()), strict=True), made, lambda x: len(x["text"] or ""), out)  # (as bytes: a text is decoded once)

    return run(kind, content)


def as_docx(paragraphs: Column) -> Column:
    """A DOCX file of an array of paragraphs."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            made = lambda x: None if x is None else docx.document(["" if t is None else t for t in x])
            yield from _pieces(zip(b), made, lambda x: len(x or b""), pa.binary())

    return run(paragraphs)
