"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def trim_all(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_all(c), F.lit(""))


def email_key(c: Column) -> Column:
    return F.lower(trim_all(c))


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def last_items(c: Column, n: int) -> Column:
    return F.when(F.size(c) > n, F.slice(c, -n, n)).otherwise(c)


def is_email(c: Column) -> Column:
    return c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def is_colour(c: Column) -> Column:
    return c.rlike(r"^#[0-9a-fA-F]{6}$")


def is_phone(c: Column) -> Column:
    return digits(c).rlike(r"^[0-9]{8,15}$")


# Addresses of videos, and what stands before their ids.
VIDEO_SITE = r"^https://(www\.)?(youtube\.com|youtu\.be)/"
VIDEO_ID = r"(?:youtu\.be/|youtube\.com/(?:watch\?v=|embed/|shorts/))([A-Za-z0-9_-]{11})"


def is_video(c: Column) -> Column:
    """An address of a video site."""
    return c.rlike(VIDEO_SITE)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def video_id(c: Column) -> Column:
    """The id in a watch, short or embed address; empty without one."""
    return F.regexp_extract(c, VIDEO_ID, 1)


def safe_name(c: Column, longest: int = 120) -> Column:
    """A file name: characters other than word characters, dots, Arabic letters and dashes become one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^\w.؀-ۿ-]", "_"), "_+", "_"), 1, longest)


def escape_html(c: Column, breaks: bool = False) -> Column:
    """Ampersands first, so that what is put in is not escaped again."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(c, F.lit("\n"), F.lit("<br>")) if breaks else c


# What is scrubbed, in this order, what stands for it, how much of a text is kept and what is said of the rest.
SECRETS = (
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[redacted-token]"),
    (r"(?i)(ds_token=|token=|authorization:\s*bearer\s+|bearer\s+)[A-Za-z0-9._-]+", "$1[redacted-token]"),
    (r"(?i)\b[a-f0-9]{32,}\b", "[redacted-hex]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted-email]"),
)
LONGEST = 2000
CUT_OFF = "…[+{} chars]"


def scrub(c: Column, longest: int = LONGEST) -> Column:
    """Without tokens, keys, hashes and addresses; long texts are cut, with the number of characters (code points) left out."""
    for pattern, stand_in in SECRETS:
        c = F.regexp_replace(c, pattern, stand_in)
    before, after = CUT_OFF.split("{}")
    over = F.concat(F.substring(c, 1, longest), F.lit(before), (F.length(c) - longest).cast("string"), F.lit(after))
    return F.when(F.length(c) > longest, over).otherwise(c)


def no_query(url: Column) -> Column:
    return F.split_part(url, F.lit("?"), F.lit(1))


def hops(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), trim_all), lambda x: x != "")


def first_hop(c: Column) -> Column:
    """The address that the client claims."""
    return F.try_element_at(hops(c), F.lit(1))


def last_hop(c: Column) -> Column:
    """The address that the nearest proxy saw."""
    return F.try_element_at(hops(c), F.lit(-1))


def names(csv: Column) -> Column:
    return F.filter(F.transform(F.split(csv, ","), lambda x: F.lower(trim_all(x))), lambda x: x != "")


def extension(c: Column) -> Column:
    return F.upper(F.element_at(F.split(c, r"\."), -1))


def file_kind(c: Column) -> Column:
    """The first kind whose mark a type or name holds, in whatever case; a picture's extension counts with its dot only."""
    t = F.lower(c)
    return (
        F.when(t.contains("pdf"), "pdf").when(t.contains("doc"), "word").when(t.contains("xls") | t.contains("sheet"), "sheet")
        .when(t.contains("image") | t.rlike(r"\.(jpg|jpeg|png|gif|webp)"), "image").otherwise("other")
    )


def joined(sep: str, *parts: Column) -> Column:
    """Non-blank parts with a separator."""
    return F.array_join(F.filter(F.array(*[trim_all(p.cast("string")) for p in parts]), lambda x: x.isNotNull() & (x != "")), sep)


def filled(template: str, **fields: Column) -> Column:
    """A template with {name} places; blank fields are dotted lines."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.nullif(trim_all(c.cast("string")), F.lit("")), F.lit("........")))
    return out


def label(c: Column, names_: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in names_.items() for x in kv])
    return F.coalesce(F.try_element_at(known, c), c)


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(c), " +"), 1, n), " ")


def padded(c: Column, n: int) -> Column:
    """Zeros in front up to n characters; longer values stay whole."""
    s = c.cast("string")
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, "0"))


def in_fours(c: Column) -> Column:
    return F.regexp_replace(c, "(.{4})(?=.)", "$1 ")


def quoted_only(excerpts: Column, source: Column) -> Column:
    """Each excerpt if the source holds it word for word, else empty."""
    return F.transform(excerpts, lambda x: F.when(F.contains(source, x), x).otherwise(""))


def filled_lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: trim_all(x) != "")


def strong_secret(c: Column, denied: tuple[str, ...] = ("changeme", "secret", "password")) -> Column:
    return (F.length(c) >= 32) & ~F.lower(c).isin(*denied)


def inside(path: str, root: str) -> bool:
    """Whether a path, put in order, lies within a root."""
    import posixpath

    full, base = posixpath.normpath(posixpath.join(root, path)), posixpath.normpath(root)
    return full == base or full.startswith(base.rstrip("/") + "/")
