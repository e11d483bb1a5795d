"""Mixing sources to target weights by a low-discrepancy schedule.

1. Sizes.  A document's size is its number of white-space separated words.
2. Targets.  Sources share the total by weight; no target exceeds
   ``max_epochs`` times its source and what a full source leaves over is shared
   by the others, by weight, until none is above (water filling, solved in one
   pass over the sources sorted by the level at which they fill).
3. Schedule.  Slot i of the mix has the point frac(i * golden ratio), held as
   an integer lattice point so that it is exact at any i; the point falls into
   one source's interval of the cumulative targets.  Slots are ranked within
   their source.
4. Blocks.  A source's documents, shuffled by a hash, form one stream of words
   that is read round and round and cut into blocks of as many words as a slot
   holds; the slot of rank r takes block r.  ``pieces`` joins the blocks to their
   slots, ``mix`` sums the pieces of each document, ``ordered`` gives the documents
   in the order of the slots.
5. Remainders.  A source whose target is smaller than a slot may have no slot, or
   one too many.  A source that the schedule
   leaves off its target by more than ``OFF`` of it (and a word) takes its target,
   rounded; its blocks beyond its own slots share slots spread over the mix.

Words are counted once for each document and written with its id and source.
A source's words are numbered by two-level prefix sums (hash ranges, then rows
of a range), so no task sees a whole source.  Everything here is DataFrame
expressions; there is no Python on the executors.

Edge cases: null or empty texts have size 0 and take 0; a null source is a
source of its own, last in order; repeated rows are separate rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import drop, saved

#: A lattice of 2^31 points; the step is the odd integer next to 2^31 / golden ratio.
LATTICE = 1 << 31
STEP = 1327217885
CELLS = 4096
#: Up to so many sources their table (a row each) is broadcast, else joined by shuffle.
MOST_BROADCAST = 20_000
#: The share of its target by which the schedule may leave a source off it.
OFF = 0.001


def words(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09 to 0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, n_docs, weight, target, lo, hi): one row for each source.

    lo and hi bound the source's interval of the cumulative targets, in lattice
    points.  ``sizes``: source, size.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ladder = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("k", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(ladder, ((F.col("k") - 1) % len(weights) + 1).cast("int")).cast("double")
    )
    # fills: the level of words a unit of weight at which the source is full
    per = per.withColumn("room", F.col("source_size") * max_epochs).withColumn("fills", F.col("room") / F.col("weight"))
    every = W.partitionBy()
    upto = W.orderBy("fills", "k").rowsBetween(W.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(every))
        .withColumn("used", F.coalesce(F.sum("room").over(upto), F.lit(0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        # the level if all sources before this one are full and none after
        .withColumn("level", (F.col("total") - F.col("used")) / F.col("left"))
        .withColumn("at", F.max(F.when(F.col("level") <= F.col("fills"), F.col("level"))).over(every))
        .withColumn("target", F.round(F.least(F.col("room").cast("double"), F.coalesce("at", F.lit(0.0)) * F.col("weight")), 6))
    )
    run = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    sum_all = F.sum("target").over(every)
    per = per.withColumn(
        "hi", F.when(sum_all > 0, F.round(F.sum("target").over(run) / sum_all * LATTICE)).otherwise(0).cast("long")
    ).withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("k")), F.lit(0).cast("long")))
    return per.select("source", "k", "source_size", "n_docs", "weight", "target", "lo", "hi", "total")


def schedule(spark, per_source: DataFrame, n_slots: int) -> DataFrame:
    """(slot, k): the source number of every slot, in slot order of the mix."""
    parts = max(1, min(2000, n_slots // 50_000))
    slots = spark.range(0, n_slots, 1, parts).select(
        F.col("id").alias("slot"), (((F.col("id") % LATTICE) * STEP) % LATTICE).alias("u")
    ).withColumn("cell", F.expr(f"u div {LATTICE // CELLS}"))
    cells = (
        per_source.where("hi > lo")
        .select("k", "lo", "hi", F.explode(F.expr(f"sequence(lo div {LATTICE // CELLS}, (hi - 1) div {LATTICE // CELLS})")).alias("cell"))
    )
    return slots.join(cells, "cell").where("u >= lo and u < hi").select("slot", "k")


def amounts(per_source: DataFrame, taken: DataFrame, slots: int, max_epochs: int) -> DataFrame:
    """``per_source`` with n_slots, block (words a slot) and words_taken; taken: (k, n_slots) of the sources with slots."""
    scheduled = F.least(F.round(F.col("n_slots") * F.col("block")).cast("long"), F.col("source_size") * max_epochs)
    off = F.abs(scheduled - F.col("target")) > F.greatest(F.lit(1.0), F.col("target") * OFF)
    return (
        per_source.join(taken.select(F.col("k").alias("t_k"), F.col("n_slots").alias("t_n")), F.col("k") == F.col("t_k"), "left")
        .withColumn("n_slots", F.coalesce("t_n", F.lit(0).cast("long")))
        .withColumn("block", F.greatest(F.col("total") / slots, F.lit(1e-9)))  # no words: nothing is cut
        .withColumn("words_taken", F.when(off, F.round("target").cast("long")).otherwise(scheduled))
        .drop("t_k", "t_n")
    )


def ranked(slots: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """Adds rank: the slot's place among its source's slots, from 0.

    Stretches of slots are counted first, so no window holds a whole source."""
    s = slots.withColumn("stretch", F.expr(f"slot div {stretch}"))
    counts = s.groupBy("k", "stretch").agg(F.count("*").alias("n"))
    before = counts.withColumn(
        "base", F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).select("k", "stretch", "base")
    inner = F.row_number().over(W.partitionBy("k", "stretch").orderBy("slot")) - 1
    return s.withColumn("inner", inner).join(before, ["k", "stretch"]).select(
        "slot", "k", (F.col("inner") + F.col("base")).alias("rank")
    )


def streams(d: DataFrame, sizes: DataFrame, per: DataFrame, rows_a_range: int = 2_000) -> DataFrame:
    """``d`` (doc_id, source, size, other columns) with the columns of ``per`` and start: the words of the source's shuffled stream before the document.

    The order is by the MD5 digest of doc_id, ties by size and doc_id; ranges of digests hold about
    ``rows_a_range`` rows of a source each.  ``sizes``: doc_id, source and size of the same rows.
    """

    def ranged(rows: DataFrame) -> DataFrame:
        digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
        return (
            rows.join(per, F.col("source").eqNullSafe(F.col("s_source")))
            .withColumn("digest", digest)
            .withColumn("range", F.expr("cast(conv(substr(digest, 1, 8), 16, 10) as bigint) * greatest(1, ceil(n_docs / " + f"{rows_a_range}" + ")) div 4294967296"))
        )

    sums = ranged(sizes).groupBy("k", "range").agg(F.sum("size").alias("n"))
    base = sums.select(
        F.col("k").alias("b_k"), F.col("range").alias("b_range"),
        F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    inside = W.partitionBy("k", "range").orderBy("digest", "size", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged(d).withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(base, (F.col("k") == F.col("b_k")) & (F.col("range") == F.col("b_range")))
        .withColumn("start", F.col("inner") + F.col("base"))
    )


#: What a document's row has of its source: number, words, share of the mix, words a slot, slots, blocks beyond them, words that the mix takes.
_SOURCE = ("k", "source_size", "target", "block", "n_slots", "more", "words_taken")


@dataclass
class Mixture:
    """The plan of a mix: written tables of (doc_id, source, size), of the sources and of (k, block_no, slot), the slot of each rank of each source."""

    sizes: DataFrame
    per: DataFrame
    ranks: DataFrame
    slots: int

    @property
    def sources(self) -> DataFrame:
        """A row a source: s_source, n_docs, lo, hi and _SOURCE; broadcast if there are few."""
        return F.broadcast(self.per) if self.per.count() <= MOST_BROADCAST else self.per


def slots_of(n: int) -> int:
    """The number of slots for so many documents."""
    return min(LATTICE, max(1 << 20, 1 << max(0, n - 1).bit_length()))


def prepare(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, slots: int | None = None) -> Mixture:
    spark = docs.sparkSession
    sizes, _ = saved(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    slots = slots or slots_of(sizes.count())
    per, path = saved(targets(sizes.select("source", "size"), weights, max_epochs), "sources")
    ranks, _ = saved(ranked(schedule(spark, per, slots)).select("k", F.col("rank").alias("block_no"), "slot"), "slots")
    taken = ranks.groupBy("k").agg(F.count("*").alias("n_slots"))
    per = amounts(per, taken, slots, max_epochs).withColumn(
        "more", F.greatest(F.lit(1), F.ceil(F.col("words_taken") / F.col("block")) - F.col("n_slots")).cast("long")
    )
    per, _ = saved(per.select(F.col("source").alias("s_source"), "n_docs", "lo", "hi", *_SOURCE), "sources")
    drop(spark, path)
    return Mixture(sizes, per, ranks, slots)


def place(m: Mixture, docs: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document (``keep`` columns of docs, doc_id, source, size) with _SOURCE and start, its place in its source's stream."""
    d = m.sizes if docs is None else docs.select("doc_id", "source", words(F.col("text")).alias("size"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    extra = [F.col(f"keep_{c}").alias(c) for c in keep if c not in ("doc_id", "source", "size")]
    return streams(d, m.sizes, m.sources.drop("lo", "hi")).select(*extra, "doc_id", "source", "size", "start", *_SOURCE)


def _turns(placed: DataFrame) -> DataFrame:
    """A row for each time that the stream of a source is read over a document, with ``from`` and ``to``: words of the stream read round and round."""
    d = placed.where("size > 0 and start < words_taken")
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(words_taken - start - 1) div source_size"))))
    d = d.withColumn("from", F.col("epoch") * F.col("source_size") + F.col("start"))
    return d.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words_taken")))


def _border(n: Column) -> Column:
    """Words of the stream before block n."""
    return F.round(n * F.col("block")).cast("long")


def _joined(blocks: DataFrame, m: Mixture) -> DataFrame:
    """``blocks`` (k, block_no, n_slots, more) with slot: that of the source with the block's number for its rank.

    The j-th of a source's ``more`` blocks without a slot of their own: spread evenly, from another place for each source."""
    spread = F.expr(f"((bigint(k) * {STEP} + ((block_no - n_slots) * {LATTICE}) div more) % {LATTICE}) * {m.slots} div {LATTICE}")
    return blocks.join(m.ranks, ["k", "block_no"], "left").withColumn("slot", F.coalesce("slot", spread))


def pieces(placed: DataFrame, m: Mixture) -> DataFrame:
    """(slot, k, start, source, doc_id, epoch, first, n): which words of which document each slot of the mix holds.

    A document's turns are cut at the block borders and joined to the slots on (source number, block number);
    (k, start) tells documents with words from each other."""
    d = _turns(placed).withColumn(
        "block_no", F.explode(F.sequence(F.greatest(F.floor(F.col("from") / F.col("block")) - 1, F.lit(0)), F.floor(F.col("to") / F.col("block")) + 1))
    )
    d = d.withColumn("lo", F.greatest("from", _border(F.col("block_no")))).withColumn("hi", F.least("to", _border(F.col("block_no") + 1)))
    return _joined(d.where("lo < hi"), m).select(
        "slot", "k", "start", "source", "doc_id", "epoch", (F.col("lo") - F.col("from")).alias("first"), (F.col("hi") - F.col("lo")).alias("n")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, slots: int | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, start, taken, copies) of every document.

    taken: the words of it that all slots hold, repeats counted; copies: how often a slot holds its first word."""
    m = prepare(docs, weights, max_epochs, slots)
    placed, _ = saved(place(m), "placed")
    held = pieces(placed, m).groupBy(F.col("k").alias("h_k"), F.col("start").alias("h_start")).agg(
        F.sum("n").alias("taken"), F.sum((F.col("first") == 0).cast("long")).alias("copies")
    )
    same = (F.col("k") == F.col("h_k")) & (F.col("start") == F.col("h_start")) & (F.col("size") > 0)
    return placed.join(held, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", "start",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("copies", F.lit(0).cast("long")).alias("copies"),
    )


def ordered(docs: DataFrame, keep: tuple[str, ...], **how) -> DataFrame:
    """(slot, ``keep`` columns) of every document as often as a slot holds its first word, sorted by slot (files follow each other in that order)."""
    m = prepare(docs, **how)
    at = F.floor(F.col("from") / F.col("block"))
    d = _turns(place(m, docs, keep)).withColumn("block_no", at)
    d = d.withColumn("block_no", F.expr("block_no") + F.when(F.col("from") < _border(at), -1).when(F.col("from") >= _border(at + 1), 1).otherwise(0))
    return _joined(d, m).select("slot", *keep).repartitionByRange("slot").sortWithinPartitions("slot")
