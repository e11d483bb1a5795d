"""Token ids as binary shards with a minimal perfect hash index.

A shard holds a range of documents in ascending (doc_id, hash of the text)
order, null ids first.  Its file ``*.ids``, all little-endian:

    payload   ids of all documents one after the other, u16 or u32
    doc_ids   i64 a document (0 for null)
    nulls     u8 a document
    starts    i64 a document and one more: ids before it in the shard
    sizes     i64 a level of the index
    words     u64 words of the index
    ranks     i64 a word and one more: set bits before it
    rest      u64 keys beside the index
    prints    u32 a distinct key: its fingerprint
    rows      i64 a distinct key: its first document (repeated ids follow each other; null ids come first)
    counts    i64 a distinct key: its documents
    footer    magic, id width, number of documents without an id, number of items of each part

A reader opens a shard by its footer alone and finds a key by a constant number of
small reads at computed places: some words of the index, a rank, a fingerprint, a
row and a count, two starts, then the ids.  A scan of payloads needs no parsing.  A
shard is written by one task as it encodes, ends at ROLL bytes of payload, and is moved into place when whole; a
manifest lists the shards that count, so files of lost attempts are never read.

Edge cases: a null text is empty and has the end id only; rows with the same
doc_id are separate documents, ordered by their texts' hashes (rows with one
doc_id and text are alike, so their order makes no difference); an empty table
gives a manifest without rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .mph import Index, locate
from .shared import new_path, saved, slices
from .storage import reading, writing

MAGIC = b"CLOOMID2"
_PARTS = {"doc_ids": "<i8", "nulls": "u1", "starts": "<i8", "sizes": "<i8", "words": "<u8", "ranks": "<i8", "rest": "<u8", "prints": "<u4", "rows": "<i8", "counts": "<i8"}
_FOOTER = struct.Struct(f"<8s{2 + len(_PARTS)}q")
MANIFEST = "file string, part int, shard int, n_docs long, n_ids long, first_id long, last_id long, n_null long"
#: Bytes of payload from which a shard ends and the task begins its next one; what a shard keeps in memory follows from it.
ROLL = 256 << 20


def _write_shard(out, batches: Iterator, encoder, end_id: int, roll: int) -> tuple:
    """Takes batches until the payload is large enough; the shard's part of the manifest."""
    ids: list[np.ndarray] = []
    nulls: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    end = np.array([end_id], encoder.dtype).tobytes()
    width = len(end)
    for b in batches:
        column = b.column("doc_id")
        nulls.append(np.asarray(column.is_null().to_numpy(zero_copy_only=False), "u1"))
        ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("i8"))
        encoded = encoder.encode([t or "" for t in b.column("text").to_pylist()])
        counts.append(np.fromiter((len(e) // width + 1 for e in encoded), "i8", count=len(encoded)))
        for e in encoded:
            out.write(e)
            out.write(end)
        if out.tell() >= roll:
            break
    doc_ids, null, n = np.concatenate(ids), np.concatenate(nulls), np.concatenate(counts)
    starts = np.concatenate(([0], np.cumsum(n))).astype("<i8")
    first = np.flatnonzero(np.concatenate(([True], (doc_ids[1:] != doc_ids[:-1]) | (null[1:] != null[:-1]))))
    where = first[null[first] == 0]  # documents without an id come first and need no index
    distinct = doc_ids[where].view("u8")
    index = Index.build(distinct)
    rows, times = np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<i8")
    number = index.numbers(distinct)
    rows[number], times[number] = where, np.diff(np.append(first, len(doc_ids)))[null[first] == 0]
    parts = [doc_ids, null, starts, index.sizes, index.words, index.ranks, index.rest, index.prints, rows, times]
    for p, kind in zip(parts, _PARTS.values(), strict=True):
        out.write(p.astype(kind).tobytes())
    out.write(_FOOTER.pack(MAGIC, width, int(null.sum()), *map(len, parts)))
    named = doc_ids[int(null.sum()) :].tolist()
    return len(doc_ids), int(starts[-1]), *((named[0], named[-1]) if named else (None, None)), int(null.sum())


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, roll: int = ROLL) -> tuple[DataFrame, str]:
    """Writes the shards; the manifest (MANIFEST with base: ids of all shards before) and the folder.

    A task writes a shard for every ``roll`` bytes of payload or so of its range of documents."""
    spark = docs.sparkSession
    path = path or new_path(spark, "ids")
    d = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    d = d.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches):
        import itertools

        from pyspark import TaskContext

        from .tokens import Encoder, _tokenizer

        batches = slices(b for b in batches if b.num_rows)
        first, shard = next(batches, None), 0
        wide = first is not None and _tokenizer(tokenizer).get_vocab_size() > 1 << 16
        while first is not None:
            encoder = _encoder(Encoder, tokenizer, "<u4" if wide else "<u2")
            name = f"{path}/{uuid.uuid4().hex}.ids"
            with writing(name) as out:
                made = _write_shard(out, itertools.chain([first], batches), encoder, end_id, roll)
            row = dict(zip(_ARROW.names, (name, TaskContext.get().partitionId(), shard, *made), strict=True))
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)
            first, shard = next(batches, None), shard + 1

    listed, _ = saved(d.mapInArrow(run, MANIFEST), "manifest")
    # shards are ranges in the order of their tasks' numbers and of their own; the window is over a row a shard
    order = W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)
    return listed.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0))), path


_ARROW = pa.schema([("file", pa.string()), ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_null", pa.int64())])
_ENCODERS: dict = {}


def _encoder(cls, path: str, dtype: str):
    """One a worker, so that it keeps what it has learnt for its next tasks."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = cls(path, dtype)
    return _ENCODERS[path, dtype]


class Part:
    """An array in a file: items and slices of it are read when asked for."""

    def __init__(self, shard: Shard, at: int, n: int, kind: str):
        self.shard, self.at, self.n, self.kind = shard, at, n, np.dtype(kind)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int | slice) -> np.ndarray:
        first, last = (i.start or 0, self.n if i.stop is None else i.stop) if isinstance(i, slice) else (i, i + 1)
        got = np.frombuffer(self.shard.bytes(self.at + first * self.kind.itemsize, (last - first) * self.kind.itemsize), self.kind)
        return got if isinstance(i, slice) else got[0]


class Shard:
    """An opened shard.  Opening reads its footer; ``taken`` counts all bytes read."""

    def __init__(self, file: str):
        self.f, self.taken = reading(file), 0
        size = self.f.size()
        magic, self.width, self.n_null, *counts = _FOOTER.unpack(self.bytes(size - _FOOTER.size, _FOOTER.size)) if size >= _FOOTER.size else (b"", 0, 0)
        if magic != MAGIC:
            raise ValueError(f"not a shard: {file}")
        at = size - _FOOTER.size - sum(n * np.dtype(k).itemsize for n, k in zip(counts, _PARTS.values(), strict=True))
        for name, n in zip(_PARTS, counts, strict=True):
            part = Part(self, at, n, _PARTS[name])
            setattr(self, name, part)
            at += n * part.kind.itemsize

    def bytes(self, position: int, n: int) -> bytes:
        self.f.seek(position)
        self.taken += n
        return self.f.read(n)

    def locate(self, doc_id: int | None) -> tuple[int, int]:
        """First and last + 1 document of a key, equal if the shard has none: a constant number of reads."""
        if doc_id is None:
            return 0, self.n_null
        key = doc_id % (1 << 64)
        n = locate(key, self.sizes[:].tolist(), self.words.__getitem__, self.ranks.__getitem__, self.rest.__getitem__, len(self.rest))
        if n < 0 or self.prints[n] != Index.fingerprint(np.array([key], "u8"))[0]:
            return 0, 0
        first = int(self.rows[n])
        return (first, first + int(self.counts[n])) if self.doc_ids[first] == doc_id else (0, 0)

    def locate_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As locate() for many keys (none of them null), with the whole index in memory."""
        index = Index(self.sizes[:], self.words[:], self.rest[:], self.prints[:])
        n = index.find(ids.astype("i8").view("u8"))
        rows, counts = (self.rows[:], self.counts[:]) if len(self.rows) else (np.zeros(1, "i8"),) * 2
        first, held = rows[np.maximum(n, 0)], self.doc_ids[:] if len(self.doc_ids) else np.zeros(1, "i8")
        there = (n >= 0) & (held[first] == ids)
        return np.where(there, first, 0), np.where(there, first + counts[np.maximum(n, 0)], 0)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of documents first to last - 1, as u32."""
        a, b = (int(x) for x in self.starts[first : last + 1][[0, -1]])
        return self.span(a, b)

    def span(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self.bytes(a * self.width, (b - a) * self.width), f"<u{self.width}").astype("<u4")


def read(spark: SparkSession, manifest: DataFrame, block: int = 1 << 22) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, found by its key and read from the shards."""

    def run(batches):
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                s = Shard(file)
                ids, nulls, starts = s.doc_ids[:], s.nulls[:].astype(bool), s.starts[:]
                distinct = np.flatnonzero(~nulls & np.append(True, (np.diff(ids) != 0) | (np.diff(nulls.view("i1")) != 0))[: len(ids)])
                first, last = s.locate_all(ids[distinct])
                if int((last - first).sum()) + s.n_null != len(ids):
                    raise ValueError(f"the index of {file} does not find all its keys")
                docs = np.concatenate([np.arange(s.n_null), *(np.arange(a, z) for a, z in zip(first, last, strict=True))]).astype("i8")
                crc, held, at = np.zeros(len(docs), "i8"), np.zeros(0, "<u4"), (0, 0)
                for i, d in enumerate(docs.tolist()):
                    a, z = int(starts[d]), int(starts[d + 1])
                    if not (at[0] <= a and z <= at[1]):
                        until = max(d + 1, int(np.searchsorted(starts, a + block, side="right")) - 1)
                        held, at = s.span(a, int(starts[until])), (a, int(starts[until]))
                    crc[i] = zlib.crc32(held[a - at[0] : z - at[0]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[docs], mask=nulls[docs]), pa.array(starts[docs] + base),
                        pa.array(starts[docs + 1] - starts[docs]), pa.array(crc),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = manifest.select("file", "base").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: DataFrame, keys: DataFrame, keys_a_task: int = 10_000) -> DataFrame:
    """(doc_id, ids) for every stored document whose id is in ``keys`` (column doc_id).

    The line of ids is cut into stretches, about four a shard; keys meet the shards of their stretch by equality and
    keep those whose range holds them.  Each task opens the shards that its keys need and reads a constant number of
    places a key.
    """
    ranges = manifest.select("file", "first_id", "last_id", "n_null")
    low, high, n = ranges.agg(F.min("first_id"), F.max("last_id"), F.count("*")).first()
    wide = max(1, (int(high or 0) - int(low or 0)) // max(1, 4 * n) + 1)
    stretch = lambda c: F.floor(F.col(c).cast("decimal(38,0)") / F.lit(wide).cast("decimal(38,0)")).cast("long")  # noqa: E731  no overflow at the ends of the line
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    spans = ranges.where("first_id is not null").withColumn("at", F.explode(F.sequence(stretch("first_id"), stretch("last_id"))))
    at = wanted.withColumn("at", stretch("doc_id")).join(spans, "at").where("doc_id between first_id and last_id").select("file", "doc_id")
    nameless = wanted.where("doc_id is null").crossJoin(ranges.where("n_null > 0").select("file")).select("file", "doc_id")  # one key, the shards with null ids
    dealt = at.union(nameless).repartition("file", F.expr(f"pmod(xxhash64(doc_id), greatest(1, {max(1, n)} * 64 div {keys_a_task}))")).sortWithinPartitions("file")

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    def run(batches):
        file, s = None, None
        for b in batches:
            found: list[tuple] = []
            held = 0
            for name, key in zip(b.column("file").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
                if name != file:
                    file, s = name, Shard(name)
                first, last = s.locate(key)
                for d in range(first, last):
                    found.append((key, s.ids(d, d + 1).astype("i8")))
                    held += len(found[-1][1])
                    if held > 1 << 20:
                        yield batch(found)
                        found, held = [], 0
            yield batch(found)

    return dealt.mapInArrow(run, "doc_id long, ids array<long>")
