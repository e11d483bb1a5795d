"""WARC archives (WARC/1.1): a Python data source that reads and writes them.

Reading takes plain (``.warc``) and gzip (``.warc.gz``) archives of any maker and
plans one partition for each file; the writer starts a new file every
``ROLL`` bytes, others keep theirs to a gigabyte or so, and files spread over the
cluster.  Filters on record type, target URI, record id, referred id and digest reach the reader;
it parses a record's headers first and passes over the payload of a record that
the filters refuse or that no caller wants.  Records are gzip members of their
own; the writer notes a member's length in its header's extra field (which other
tools ignore), so that a refused record is skipped by a seek.  Members of others
are inflated but not kept.  A file that ends within a record or member, or holds
something else than records, raises an error that names it.

Writing gives archives in the standard form: mandatory headers, record ids that
are URIs, labelled digests, responses as HTTP messages, revisits with their
profile.  A write has a number of its own, which its files' names hold, and ends by
writing the list of the files that its successful tasks report; a reader takes
files of a write only if they are on its list, so that what lost, repeated or
speculative attempts leave behind is never read, and an unfinished write adds
nothing.  Archives of others, whose names have no such number, are read as they are.

Edge cases: a CR or LF in a URL is percent-encoded; a page without an id gets a
random record id; header names are matched without case, continued lines are
joined; records of unknown types are returned with their block as payload.
"""

from __future__ import annotations

import dataclasses
import datetime
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)

from .shared import new_path, saved
from .storage import delete, files, reading, writing

SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary"
)
#: WARC header names and the columns that hold them; the last one is an extension, for the size of a revisited payload.
HEADERS = {
    "WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Target-URI": "target_uri",
    "WARC-Refers-To": "refers_to", "WARC-Payload-Digest": "payload_digest", "Caseloom-Payload-Length": "payload_bytes",
}
_BY_NAME = {k.lower(): v for k, v in HEADERS.items()}
_IDS = ("record_id", "refers_to")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:caseloom:page:"
ROLL = 256 << 20
#: gzip: fixed header with the extra flag; the extra field has one entry "WL" of 8 bytes, the length of the member.
_GZIP_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
_STEP = 1 << 20


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    length = len(_GZIP_HEAD) + 2 + 12 + len(body) + 8
    extra = b"WL" + struct.pack("<HQ", 8, length)
    return _GZIP_HEAD + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(row, date: str) -> bytes:
    """One record as a gzip member."""
    payload = bytes(row["payload"]) if row["payload"] is not None else b""
    lines = ["WARC/1.1", f"WARC-Date: {date}"]
    for name, column in HEADERS.items():
        if row[column] is not None:
            value = _one_line(str(row[column]))
            lines.append(f"{name}: <{value}>" if column in _IDS else f"{name}: {value}")
    block = payload
    if row["record_type"] == "response":
        lines.append("Content-Type: application/http; msgtype=response")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    elif row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines.append(f"Content-Length: {len(block)}")
    return _member(("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n")


class Torn(ValueError):
    """An archive that ends too early or is none."""


class _Stream:
    """The bytes of an archive, inflated if need be."""

    def __init__(self, f, name: str):
        self.f, self.name, self.held, self.left, self.z = f, name, b"", f.read(_STEP), None
        self.gzip = self.left[:2] == b"\x1f\x8b"
        self.at = 0  # where ``left``, the bytes that are not inflated yet, begin

    def _fetch(self) -> bool:
        more = self.f.read(_STEP)
        self.left += more
        return bool(more)

    def more(self) -> bool:
        """Holds more bytes; False at the end of the archive."""
        if not self.gzip:
            self.held, self.left, more = self.held + self.left, b"", bool(self.left)
            return more or (self._fetch() and self.more())
        if not self.left and not self._fetch():
            if self.z is not None:
                raise Torn(f"{self.name} ends within a gzip member")
            return False
        if self.z is None:
            self.z = zlib.decompressobj(31)
        taken = self.left
        try:
            self.held += self.z.decompress(taken, _STEP)
        except zlib.error as e:
            raise Torn(f"{self.name}: bad gzip member at or before byte {self.at + len(taken)}: {e}") from e
        self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        self.at += len(taken) - len(self.left)
        if self.z.eof:
            self.z = None
        return True

    def member(self) -> int | None:
        """At the start of a member with a note of its length: where the next one begins."""
        if not self.gzip or self.z is not None or self.held:
            return None
        while len(self.left) < 24 and self._fetch():
            pass
        h = self.left[:24]
        return self.at + struct.unpack_from("<Q", h, 16)[0] if len(h) == 24 and h[3] & 4 and h[12:16] == b"WL\x08\x00" else None

    def seek(self, position: int) -> None:
        """To the start of a member (or the end)."""
        if self.at <= position <= self.at + len(self.left):
            self.left = self.left[position - self.at :]
        else:
            if position > self.f.size():
                raise Torn(f"{self.name} ends within a gzip member")
            self.f.seek(position)
            self.left = b""
        self.at, self.held, self.z = position, b"", None

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        while (k := self.held.find(b"\n")) < 0:
            if len(self.held) > 64 * _STEP:
                raise Torn(f"{self.name} is not a WARC archive")
            if not self.more():
                if self.held.strip(b"\0\r\n "):
                    raise Torn(f"{self.name} ends within a record's headers")
                return None
        out, self.held = self.held[:k], self.held[k + 1 :]
        return out.rstrip(b"\r")

    def take(self, n: int, keep: bool) -> bytes:
        parts = []
        while n > 0:
            if not self.held and not self.more():
                raise Torn(f"{self.name} ends within a record's block")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)


def records(f, name: str, wanted, payloads: bool) -> Iterator[tuple]:
    """(columns of HEADERS, payload) of an opened archive; wanted(columns) says if a record is."""
    s = _Stream(f, name)
    while True:
        following = s.member()
        while (line := s.line()) is not None and not line.strip(b"\0 "):
            pass
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise Torn(f"{name}: a record begins with {line[:40]!r}")
        fields: list[list[str]] = []
        while line := s.line():
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and fields:
                fields[-1][1] += " " + text.strip()
            else:
                key, _, value = text.partition(":")
                fields.append([key.strip().lower(), value.strip()])
        if line is None:
            raise Torn(f"{name} ends within a record's headers")
        head = dict(fields)
        if not head.get("content-length", "").isdigit():
            raise Torn(f"{name}: a record without Content-Length")
        got = {c: head.get(k) for k, c in _BY_NAME.items()}
        for c in _IDS:
            got[c] = got[c] and got[c].removeprefix("<").removesuffix(">")
        got["payload_bytes"] = int(got["payload_bytes"]) if (got["payload_bytes"] or "").isdigit() else None
        n, use = int(head["content-length"]), wanted(got)
        if not (use and payloads) and following is not None:
            s.seek(following)
        else:
            block = s.take(n, use and payloads)
            if s.take(4, True) != b"\r\n\r\n":
                raise Torn(f"{name}: a record's block does not end where its length says")
        if use:
            payload = None
            if payloads:
                http = head.get("content-type", "").replace(" ", "").startswith("application/http")
                payload = block.partition(b"\r\n\r\n")[2] if http else block
                if got["payload_bytes"] is None and got["record_type"] != "revisit":
                    got["payload_bytes"] = len(payload)
            yield (*(got[c] for c in HEADERS.values()), payload)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.wanted: list[tuple[str, tuple]] = []
        self.payloads = options.get("payloads", "true") == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("record_type", "target_uri", "record_id", "refers_to", "payload_digest"):
                self.wanted.append((column, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = archives(self.path)
        return [InputPartition(uri) for uri in found] or [InputPartition(None)]

    def read(self, partition: InputPartition):
        if partition is None or partition.value is None:  # no archives
            return
        with reading(partition.value) as f:
            yield from records(f, partition.value, lambda got: all(got[c] in values for c, values in self.wanted), self.payloads)


def _of_write(write: str, uri: str) -> str | None:
    """The number of the write that a file's name holds, or that of a list."""
    found = re.search(write, uri.rpartition("/")[2])
    return found and found[1]


def archives(path: str) -> list[str]:
    """The archives of a folder: foreign ones, and those that finished writes list."""
    listed: set[str] = set()
    for uri, _ in files(path, ".list"):
        if _of_write(r"^_caseloom-([0-9a-f]{32})\.list$", uri):
            with reading(uri) as f:
                listed |= set(json.loads(f.read()))
    found = [uri for suffix in (".warc.gz", ".warc") for uri, _ in files(path, suffix)]
    return [uri for uri in found if not _of_write(_OWN, uri) or uri.rpartition("/")[2] in listed]


#: Names of files that a write leaves.
_OWN = r"^caseloom-([0-9a-f]{32})-[0-9a-f]{32}\.warc\.gz$"


@dataclasses.dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.date, self.number = options["path"].rstrip("/"), options.get("date"), uuid.uuid4().hex
        self.roll = int(options.get("roll", ROLL))

    def write(self, iterator) -> WriterCommitMessage:
        date, names = self.date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), []
        row = next(iterator, None)
        while row is not None:
            name = f"caseloom-{self.number}-{uuid.uuid4().hex}.warc.gz"
            with writing(f"{self.path}/{name}") as out:
                while row is not None and out.tell() < self.roll:
                    out.write(encode_record(row, date))
                    row = next(iterator, None)
            names.append(name)
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        kept = sorted(n for m in messages if m is not None for n in m.names)
        with writing(f"{self.path}/_caseloom-{self.number}.list") as out:
            out.write(json.dumps(kept).encode())
        self._clear(set(kept))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(set())

    def _clear(self, kept: set[str]) -> None:
        """Deletes what this write's other attempts have left so far."""
        for uri, _ in files(self.path, ".warc.gz"):
            if _of_write(_OWN, uri) == self.number and uri.rpartition("/")[2] not in kept:
                delete(uri)


class WarcDataSource(DataSource):
    """``spark.read.format("caseloom_warc").option("path", folder)``; option payloads=false leaves payloads null, date is the WARC-Date to write, roll the bytes from which a file ends."""

    @classmethod
    def name(cls) -> str:
        return "caseloom_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def with_records(pages: DataFrame, least_bytes: int = 100, most_broadcast: int = 200_000) -> DataFrame:
    """Pages as WARC records (SCHEMA).

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id is the
    response and the others revisit it.  A null html is an empty payload.  A row whose page_id is the
    smallest again (a repeated row) is a response too; a null page_id is never smallest, and rows whose
    payload has only null ids are all responses.

    The digests that occur twice are found first and written; up to ``most_broadcast`` of them (some 10 MB) are
    broadcast, so that no payload is shuffled, more are joined by shuffle.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    twice = (
        pages.select("page_id", F.octet_length(body).alias("n"), F.unhex(F.sha2(body, 256)).alias("digest")).where(F.col("n") >= least_bytes)
        .groupBy("digest").agg(F.min("page_id").alias("smallest"), F.count("*").alias("times")).where("times > 1 and smallest is not null")
    )
    twice, _ = saved(twice.select("digest", "smallest"), "digests")
    if twice.count() <= most_broadcast:
        twice = F.broadcast(twice)
    p = pages.select("page_id", F.col("url").alias("target_uri"), body.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    revisits = F.expr("smallest is not null and (page_id is null or page_id <> smallest)")
    return p.join(twice, "digest", "left").select(
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(F.concat(F.lit(PAGE), F.col("page_id").cast("string")), F.concat(F.lit("urn:uuid:"), F.expr("uuid()"))).alias("record_id"), "target_uri",
        F.when(revisits, F.concat(F.lit(PAGE), F.col("smallest").cast("string"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.lower(F.hex("digest"))).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(~revisits, F.col("payload")).alias("payload"),
    )


def page_id(record_id: Column) -> Column:
    """The page that a record id of with_records() names; null for others."""
    return F.nullif(F.regexp_extract(record_id, f"^{PAGE}(-?[0-9]+)$", 1), F.lit("")).cast("long")


def write(records: DataFrame, path: str, roll: int = ROLL) -> None:
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("caseloom_warc").option("path", path).option("roll", str(roll)).mode("append").save()


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives in a folder; with payloads=False their payload column is null and nothing is inflated for it.

    Filters reach the reader only while ``spark.sql.python.filterPushdown.enabled`` is on, as it is planned: this turns
    it on for the session."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("caseloom_warc").option("path", path).option("payloads", str(payloads).lower()).load()


def archive(pages: DataFrame, path: str | None = None) -> str:
    """Writes pages as archives; the folder."""
    path = path or new_path(pages.sparkSession, "warc")
    write(with_records(pages), path)
    return path
