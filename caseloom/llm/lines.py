"""Line dedup: repeated runs of lines, found by prefix doubling over line ids.

The corpus is the sequence of all documents' non-blank lines, in (doc_id, line)
order; a run never crosses documents.

1. A line's id is its rank among the distinct lines that occur more than once
   (others end every repeated run, so they are left out).
2. Doubling: the rank of the first 2h lines of a suffix is the rank of the pair
   (rank of its first h lines, rank of the h lines after those) in the sorted
   table of pairs; pairs that occur once have no rank and drop out.  So after
   round j the table holds the order of all repeated suffixes by their first
   2^j lines, and each rank is one interval of the suffix array whose suffixes
   have a common prefix of at least 2^j lines.  Rounds end when no pair repeats.
3. The suffixes that share their first L lines, for any L, are those with equal
   ranks of two overlapping blocks of 2^j <= L lines, the first at the start and
   the last at the end of the L lines.  With L the fewest lines that hold
   ``min_words`` words from a line on (or up to it), equal blocks of that form
   are the common-prefix intervals of the shortest runs that count, and every
   maximal repeated run of at least ``min_words`` words is a union of such runs.
4. In each interval the first occurrence stays; lines of the others are
   deleted.  Runs may overlap their own copies (a line repeated many times).

Ranks are assigned by range-partitioned sorts with per-partition offsets; pairs
are grouped with map-side counts, so a line that all documents share is one row
a task; nothing but the number of pairs reaches the driver.

Edge cases: null, empty and blank texts have no lines and lose none; blank lines are neither compared
nor deleted; lines are compared without white space at their ends; rows with the
same doc_id are one document with the lines of both texts in order of the
texts' hashes, so a repeated row is a copy; a null doc_id comes first; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import drop, saved, slices


def _ranks(pairs: DataFrame, cols: list[str]) -> tuple[DataFrame, str]:
    """pairs with rank: the place, from 0, of each row in the order of ``cols``; rows are distinct.

    Rows are sorted over range partitions; the few counts a partition give its first rank.  Also the path of the table behind it."""
    parted, path = saved(
        pairs.repartitionByRange(*cols).sortWithinPartitions(*cols).select("*", F.monotonically_increasing_id().alias("at")), "sorted"
    )
    split = F.expr("shiftright(at, 33)")
    parted = parted.withColumn("part", split)
    counts = parted.groupBy("part").agg(F.count("*").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return parted.join(base, "part").select(*pairs.columns, (F.col("base") + F.expr("at & 8589934591")).alias("rank")), path


#: A position is the document's rank and, in its last 28 bits, the number of the line among the document's non-blank lines.
LINE_BITS = 28
_SPACE = b" \t\n\x0b\x0c\r"


def units(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the fewest lines that hold ``least`` words, from it on and up to it; 0 if there are too few words."""
    n, before = len(words), np.concatenate(([0], np.cumsum(words)))
    at = np.arange(n)
    end = np.searchsorted(before, before[:-1] + least, side="left")  # lines before end hold enough
    start = np.searchsorted(before, before[1:] - least, side="right") - 1
    return np.where(end <= n, end - at, 0), np.where(start >= 0, at - start + 1, 0)


_LINES = "uid long, doc_id long, text_hash long, line int, number int, h1 long, h2 long, ahead int, behind int"


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """Every non-blank line (_LINES): line counts non-blank lines, number all lines of the text; h1, h2 are a 128-bit hash."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches):
        from pyspark import TaskContext
        from xxhash import xxh3_128_digest

        uid = TaskContext.get().partitionId() << 33
        names = [c.split()[0] for c in _LINES.split(", ")]
        for b in slices(batches):
            out: list[list] = [[] for _ in names]
            for doc_id, text_hash, text in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text"), strict=True):
                kept = [(i, s) for i, s in enumerate(x.strip(_SPACE) for x in text.as_py().split(b"\n")) if s]
                if kept:
                    n = len(kept)
                    ahead, behind = units(np.array([len(s.split()) for _, s in kept]), min_words)
                    h = np.frombuffer(b"".join(xxh3_128_digest(s) for _, s in kept), "<i8").reshape(-1, 2)
                    rows = ([uid] * n, [doc_id] * n, [text_hash] * n, range(n), [i for i, _ in kept], h[:, 0], h[:, 1], ahead, behind)
                    for o, r in zip(out, rows, strict=True):
                        o.extend(r)
                uid += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names)

    return d.mapInArrow(run, _LINES)


def _repeated(rows: DataFrame, cols: list[str], name: str) -> tuple[DataFrame, str, bool]:
    """(p, rank) of the rows whose ``cols`` occur more than once."""
    groups = rows.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1").select(*cols)
    ranked, path = _ranks(groups, cols)
    out, out_path = saved(rows.join(ranked, cols).select("p", F.col("rank").alias("r")), name)
    drop(rows.sparkSession, path)
    return out, out_path, not out.isEmpty()


def removals(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, text_hash, copy, n_lines, removed): of every document, the numbers (from 0) of the lines to delete.

    copy numbers, from 0, the rows with one doc_id and text (0 for all that have no lines).
    """
    spark = docs.sparkSession
    table, table_path = saved(lines(docs, min_words), "lines")
    ranked, ranked_path = _ranks(table.groupBy("uid").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash")), ["doc_id", "text_hash", "uid"])
    docs_at, docs_path = saved(ranked.select("uid", F.col("rank").alias("doc")), "line_docs")
    placed, placed_path = saved(
        table.join(docs_at, "uid").withColumn("p", F.expr(f"shiftleft(doc, {LINE_BITS}) + line")).drop("uid", "line"), "line_places"
    )
    drop(spark, ranked_path, docs_path, table_path)
    level, path, more = _repeated(placed.select("p", "h1", "h2"), ["h1", "h2"], "level")
    levels = [(level, path)]
    while more:
        h = 1 << (len(levels) - 1)
        after = level.select((F.col("p") - h).alias("p"), F.col("r").alias("r2"))
        level, path, more = _repeated(level.join(after, "p"), ["r", "r2"], "level")
        levels.append((level, path))
    ranks = None
    for j, (t, _) in enumerate(levels[:-1]):
        t = t.select(F.lit(j).alias("level"), "p", "r")
        ranks = t if ranks is None else ranks.union(t)
    marks = placed.select("p").limit(0).select("p", F.lit(0).alias("length"))
    if ranks is not None:
        runs = placed.where("ahead > 0").select("p", F.col("ahead").alias("length")).union(
            placed.where("behind > 0").select((F.col("p") - F.col("behind") + 1).alias("p"), F.col("behind").alias("length"))
        ).distinct()
        runs = runs.withColumn("level", F.expr("cast(floor(log2(length)) as int)")).withColumn("tail", F.expr("p + length - shiftleft(1, level)"))
        runs = runs.join(ranks, ["level", "p"]).join(ranks.select("level", F.col("p").alias("tail"), F.col("r").alias("r2")), ["level", "tail"])
        first = runs.groupBy("length", "r", "r2").agg(F.min("p").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        marks = runs.join(first, ["length", "r", "r2"]).where("p > first").select("p", "length")
    marks = marks.groupBy("p").agg(F.max("length").alias("length"))
    every = placed.join(marks, "p", "left").select("p", "doc", "doc_id", "text_hash", "number", F.expr("p + coalesce(length, 0)").alias("until"))
    reach = F.max("until").over(W.partitionBy("doc").orderBy("p").rowsBetween(W.unboundedPreceding, 0))
    found = every.withColumn("gone", reach > F.col("p")).groupBy("doc", "doc_id", "text_hash").agg(
        F.count("*").cast("int").alias("n_lines"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("number")))).alias("removed")
    )
    found, _ = saved(found, "removals")
    drop(spark, placed_path, *(p for _, p in levels))
    copy = (F.row_number().over(W.partitionBy("doc_id", "text_hash").orderBy("doc")) - 1).alias("copy")
    blank = docs.where(~F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.lit(0).alias("copy"), F.lit(0).alias("n_lines"),
        F.expr("cast(array() as array<int>)").alias("removed"),
    )
    return found.select("doc_id", "text_hash", copy, "n_lines", "removed").union(blank)


def clean(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with the later copies of repeated line runs deleted from text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no other column's name can clash
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), row)
    d = d.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "hash").orderBy(F.lit(0))) - 1)
    gone = removals(docs, min_words).where("size(removed) > 0").select(
        F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"), F.col("copy").alias("g_copy"), "removed"
    )
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("hash") == F.col("g_hash")) & (F.col("copy") == F.col("g_copy"))
    kept = F.expr(r"array_join(filter(split(text, '\n'), (x, i) -> not array_contains(removed, i)), '\n')")
    out = d.join(gone, same, "left").withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept))
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
