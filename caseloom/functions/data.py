"""JSON, arrays, maps, digests and bytes as Column expressions; Python only where rewriting or HMAC asks for it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from .rewrite import DROP, KEEP, Mode, rewrite


def summary(meta: Column) -> Column:
    """What a log entry shows of its metadata: fields, reason, status or type, whichever is first; else its first three entries."""
    entries = F.slice(F.map_entries(F.from_json(meta, "map<string,string>")), 1, 3)
    rest = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ", ")
    return F.coalesce(*[F.get_json_object(meta, f"$.{k}") for k in ("fields", "reason", "status", "type")], rest)


REVIEW = "summary string, parties array<string>, risks array<struct<level: string, text: string, excerpt: string>>"


def valid_review(body: Column, levels: tuple[str, ...] = ("low", "medium", "high")) -> Column:
    """Whether a JSON answer has a summary, parties that are all texts, and risks that all have a known level and a text."""
    r = F.from_json(body, REVIEW)
    risks = F.forall(r["risks"], lambda x: x["level"].isin(*levels) & x["text"].isNotNull())
    return F.coalesce(r["summary"].isNotNull() & F.forall(r["parties"], lambda x: x.isNotNull()) & risks, F.lit(False))


def text_list(body: Column) -> Column:
    """An array of texts, or null if it is none."""
    a = F.from_json(body, "array<string>")
    return F.when(F.forall(a, lambda x: x.isNotNull()), a)


def supplied(patch: Column, known: list[str]) -> Column:
    """Names of the known fields that a patch (a map) supplies, whether their values change or not, in the order of ``known``."""
    return F.filter(F.array(*map(F.lit, known)), lambda k: F.map_contains_key(patch, k))


def entries_map(entries: Column) -> Column:
    """A map of (key, value) structs; of a repeated key the last one counts."""
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"].cast("string"), e["value"].cast("string"))))


def known_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def untampered(stored: Column, content: Column) -> Column:
    """Whether the digest still holds; null where the content, or the stored digest, is unknown."""
    return stored == F.sha2(content.cast("binary"), 256)


def to_base64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c.cast("binary")), "+/", "-_"), F.lit("="))


def from_base64url(c: Column) -> Column:
    std = F.translate(c, "-_", "+/")
    return F.unbase64(F.rpad(std, (F.ceil(F.length(std) / 4) * 4).cast("int"), F.lit("=")))


# The first bytes, as hexadecimal digits, of files with these extensions.
FIRST_BYTES = {
    "PDF": "25504446", "PNG": "89504E47", "JPG": "FFD8FF", "JPEG": "FFD8FF", "DOC": "D0CF11E0A1B11AE1", "XLS": "D0CF11E0A1B11AE1", "DOCX": "504B", "XLSX": "504B",
}


def signature_fits(kind: Column, content: Column) -> Column:
    """Whether a file's first bytes are those of its extension; a TXT has no NUL among its first 1,024; others never fit."""
    text_ = ~F.contains(F.substring(content, 1, 1024), F.lit(b"\0"))
    out = F.when(kind == "TXT", text_)
    for k, head in FIRST_BYTES.items():
        out = out.when(kind == k, F.hex(F.substring(content, 1, len(head) // 2)) == head)
    return F.coalesce(out, F.lit(False))


# How deep values are scrubbed and what stands for deeper ones; what a report of an error never carries.
DEEPEST, TOO_DEEP = 6, "[max-depth]"
DROPPED_REQUEST, DROPPED_HEADERS = ("data", "cookies"), ("cookie", "authorization", "x-internal-service-key")


def _scrubber():
    """A text without secrets, cut where it is long."""
    import re

    from .text import CUT_OFF, LONGEST, SECRETS

    patterns = [(re.compile(p, re.ASCII), s.replace("$1", r"\1")) for p, s in SECRETS]

    def clean(x: str) -> str:
        for p, s in patterns:
            x = p.sub(s, x)
        return x if len(x) <= LONGEST else x[:LONGEST] + CUT_OFF.format(len(x) - LONGEST)

    return clean


def _scrubbed() -> Mode:
    """All texts scrubbed, what lies deeper than DEEPEST replaced."""
    clean, mode = _scrubber(), Mode(instead=TOO_DEEP)
    for _ in range(DEEPEST + 1):
        mode = Mode(text=clean, each=mode)
    return mode


def _report() -> Mode:
    """An error report: what is not named here is kept as it is."""
    value = _scrubbed()
    crumb = Mode(members={"message": value, "data": value}, each=KEEP)
    headers = Mode(members=dict.fromkeys(DROPPED_HEADERS, DROP), each=KEEP)
    request = Mode(
        members={**dict.fromkeys(DROPPED_REQUEST, DROP), "headers": headers, "query_string": Mode(text=lambda _: "", each=KEEP), "url": Mode(text=lambda u: u.partition("?")[0], each=KEEP)}, each=KEEP
    )
    exception = Mode(members={"values": Mode(each=Mode(members={"value": value}, each=KEEP))}, each=KEEP)
    # crumbs come as a list, or as an object with a list of values
    crumbs = Mode(members={"values": Mode(each=crumb)}, each=crumb)
    named = {"user": DROP, "request": request, "message": value, "exception": exception, "breadcrumbs": crumbs, "extra": value, "contexts": value}
    return Mode(members=named, each=KEEP)


def _rewritten(column: Column, mode: Mode, objects: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None or (objects and not t.lstrip(" \t\n\r").startswith("{")) else rewrite(t, mode))

    return run(column)


def scrub_json(column: Column) -> Column:
    """A JSON text with all its texts scrubbed, down to a depth; null if it is none."""
    return _rewritten(column, _scrubbed())


def scrub_event(column: Column) -> Column:
    """An error report (JSON) without its user, its request's body, cookies, secret headers and query; messages, crumbs and extras scrubbed.

    Members of other shapes than a report's are kept as they are; a text that is no JSON object gives null."""
    return _rewritten(column, _report(), objects=True)


def signed(body: Column, signature: Column, secret: str) -> Column:
    """Whether a hex HMAC-SHA256 of the body under the secret is the signature."""
    import hashlib
    import hmac

    key = secret.encode()

    @F.pandas_udf("boolean")
    def run(b: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and hmac.compare_digest(hmac.new(key, x.encode(), hashlib.sha256).hexdigest(), y) for x, y in zip(b, s, strict=True)])

    return run(body, signature)
