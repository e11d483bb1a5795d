"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits; a bit is set if it is set in over half of the XXH64
(seed 42) values of the text's word shingles, repeats included.

Linking (at most ``bits`` differing bits) works on distinct fingerprints:

* the correlation of bits is summed over all of them and correlated bits are
  put in one partition;
* a pair within t bits is within t_i bits in some partition i as long as the
  sum of (t_i + 1) is t + 1.  The thresholds are allotted by a dynamic program
  over the estimated cost of probing and of the candidates (numbers of equal
  values are counted, farther ones follow from the bits' frequencies); 1 to
  t + 1 partitions are tried;
* each fingerprint is stored under its own values and probes those within t_i;
  candidates are verified by their differing bits;
* a bucket of more than ``bucket`` fingerprints is never expanded into pairs.
  Two fingerprints are within two bits exactly if some value is within one bit
  of both, so its members are linked to the smallest member that shares such a
  value: 65 rows a member, however large the bucket.

Only 64 x 64 sums and a few counts reach the driver.

Edge cases: null and empty texts have fingerprint 0, linked like any other;
with fewer words than a shingle the whole sequence is one shingle; rows with
equal fingerprints are linked; a repeated doc_id is one node; a null doc_id
takes part but names no component, so a component with null ids only is null.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .components import components
from .shared import drop, saved, slices

_CHUNK = 200_000


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    if not n:
        return 0
    set_in = np.zeros(64, "i8")
    for k in range(0, n, _CHUNK):
        part = words[k : k + _CHUNK + shingle - 1]
        if len(part) < shingle:
            grams = [b" ".join(part)]
        else:
            grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.fromiter(map(xxh64_intdigest, grams, repeat(42)), "<u8")
        set_in += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(set_in * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., doc_id, fp): fp holds the 64 bits as a long."""
    d = docs.select(*keep, "doc_id", F.col("text").cast("binary").alias("_text"))

    def run(batches):
        for b in slices(batches):
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("_text")), "u8", count=b.num_rows)
            cols = [b.column(c) for c in (*keep, "doc_id")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fp.view("i8"))], [*keep, "doc_id", "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.drop("_text").schema) + ", fp long"
    return d.mapInArrow(run, schema)


def _bit_sums(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits how many have both."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype("i8").view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("f4")
            total += (x.T @ x).astype("f8")
            n += len(x)
        flat = np.append(total.ravel(), n).astype("i8")
        yield pa.RecordBatch.from_arrays([pa.array(range(4097), pa.int32()), pa.array(flat)], ["at", "n"])

    sums = dict(fps.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect())
    both = np.array([sums.get(i, 0) for i in range(4097)], "f8")
    return int(both[4096]), both[:4096].reshape(64, 64)


def partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of correlated bits, of equal size: each grows from a seed by the bit with the largest summed correlation."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for i in range(m):
        room = 64 // m + (i < 64 % m)
        seed = max(free, key=lambda b: (corr[b, list(free)].sum(), -b))
        group = [seed]
        free.discard(seed)
        while len(group) < room:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allot(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """costs[i][u]: of partition i if it gets u = t_i + 1.  The cheapest u with sum ``budget``, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, us) in best.items():
            for u, extra in enumerate(row):
                if used + u <= budget and (used + u not in nxt or c + extra < nxt[used + u][0]):
                    nxt[used + u] = (c + extra, [*us, u])
        best = nxt
    return best[budget]


def _mask(group: list[int]) -> int:
    m = sum(1 << b for b in group)
    return m - (1 << 64) if m >> 63 else m


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plan(fps: DataFrame, bits: int) -> list[tuple[list[int], int]]:
    """(bits of the partition, threshold), thresholds from 0; partitions with threshold -1 are left out."""
    n, both = _bit_sums(fps)
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    tried = {m: partitions(n, both, m) for m in range(1, bits + 2)}
    values = F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.expr(f"fp & {_mask(g)}L").alias("v")) for m, gs in tried.items() if m > 1 for i, g in enumerate(gs)
    ])
    equal = {
        (m, i): c for m, i, c in fps.select(F.explode(values).alias("x")).groupBy("x.m", "x.i", "x.v").agg(F.count("*").alias("c"))
        .groupBy("m", "i").agg(F.sum(F.expr("c * (c - 1d) / 2"))).collect()
    }
    best = None
    for m, groups in tried.items():
        costs = []
        for i, g in enumerate(groups):
            dist = np.array([1.0])
            for b in g:
                dist = np.convolve(dist, [1 - differ[b], differ[b]])
            row = [0.0]
            for t in range(bits + 1):
                pairs = max(equal.get((m, i), 0.0), dist[: t + 1].sum() * n * n / 2)
                row.append(sum(comb(len(g), j) for j in range(t + 1)) * n + pairs)
            costs.append(row)
        cost, us = allot(costs, bits + 1)
        if best is None or cost < best[0]:
            best = (cost, [(g, u - 1) for g, u in zip(groups, us, strict=True) if u])
    return best[1]


def _flips(group: list[int], t: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for j in range(t + 1) for c in combinations(group, j)]


def links(fps: DataFrame, bits: int = 2, bucket: int = 64) -> DataFrame:
    """(a, b) of distinct fingerprints: every two within ``bits`` bits are connected by rows that are.

    ``bits`` is at most 2 (the way of large buckets rests on it).
    """
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2")
    fps = fps.select("fp")
    if bits == 0:  # distinct fingerprints are never equal
        return fps.limit(0).select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    stored, probes = None, None
    for i, (group, t) in enumerate(plan(fps, bits)):
        own = fps.select(F.lit(i).alias("i"), F.expr(f"fp & {_mask(group)}L").alias("v"), "fp")
        stored = own if stored is None else stored.union(own)
        if t:
            far = fps.select(F.lit(i).alias("i"), F.explode(F.array(*[F.expr(f"(fp & {_mask(group)}L) ^ {x}L") for x in _flips(group, t)[1:]])).alias("v"), "fp")
            probes = far if probes is None else probes.union(far)
    sizes = stored.groupBy("i", "v").agg(F.count("*").alias("n"))
    if probes is not None:
        sizes = sizes.join(probes.groupBy("i", "v").agg(F.count("*").alias("m")), ["i", "v"], "left").withColumn("n", F.col("n") + F.coalesce("m", F.lit(0)))
        probes = probes.join(sizes, ["i", "v"])
    stored = stored.join(sizes.where("n > 1"), ["i", "v"])
    near = F.expr(f"bit_count(a ^ b) <= {bits}")
    small = stored.where(f"n <= {bucket}")
    pairs = small.select("i", "v", F.col("fp").alias("a")).join(small.select("i", "v", F.col("fp").alias("b")), ["i", "v"]).where("a < b").where(near)
    out = pairs.select("a", "b")
    big = stored.where(f"n > {bucket}").select("fp")
    if probes is not None:
        some = probes.where(f"n <= {bucket}").select("i", "v", F.col("fp").alias("a")).join(small.select("i", "v", F.col("fp").alias("b")), ["i", "v"])
        out = out.union(some.where("a <> b").where(near).select("a", "b"))
        big = big.union(probes.where(f"n > {bucket}").select("fp"))
    big = big.distinct()
    values = F.explode(F.array(F.col("fp"), *[F.expr(f"fp ^ {x}L") for x in _flips(list(range(64)), 1)[1:]]))
    if bits == 1:  # a value within one bit of both that is one of the two
        hubs = big.select("fp", values.alias("hub")).join(big.select(F.col("fp").alias("hub")), "hub").where("fp <> hub")
        return out.union(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("b"))).distinct()
    hubs = big.select("fp", values.alias("hub"))
    low = hubs.groupBy("hub").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").select("hub", "low")
    star = hubs.join(low, "hub").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return out.union(star).distinct()


def classes(docs: DataFrame, bits: int = 2, shingle: int = 3, bucket: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    d, _ = saved(fingerprints(docs, shingle), "fingerprints")
    reps, reps_path = saved(d.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct_fp")
    # the nodes are fingerprints, which are never null; those of a document id with several are linked
    several = d.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low")).join(d, "doc_id")
    several = several.where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    comp = components(links(reps, bits, bucket).union(several))
    of, of_path = saved(reps.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("class")), "fp_class")
    names = of.groupBy("class").agg(F.min("rep").alias("component_id"))
    ids, _ = saved(of.join(names, "class").select("fp", "component_id"), "fp_component")
    drop(docs.sparkSession, of_path)
    drop(docs.sparkSession, reps_path)
    return d.join(ids, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, bits: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of docs that stay when one of each class does (that with the smallest doc_id).

    Of rows with that doc_id the one whose text hashes lowest stays.  Rows without a doc_id stay if their
    class names no id, one for each fingerprint.
    """
    found, path = saved(classes(docs, bits, shingle), "classes")
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no other column's name can clash
    by_id = W.partitionBy("doc_id").orderBy("h")
    named = docs.select("doc_id", F.xxhash64("text").alias("h"), row).join(first, "doc_id", "left_semi")
    out = named.withColumn("n", F.row_number().over(by_id)).where("n = 1").select("row.*")
    nameless = docs.where("doc_id is null").select("doc_id", "text", F.xxhash64("text").alias("h"), row)
    if not nameless.isEmpty():
        alone = found.where("doc_id is null and component_id is null").select("fp").distinct()
        own = fingerprints(nameless, shingle, ("h", "row")).join(alone, "fp", "left_semi")
        out = out.unionByName(own.withColumn("n", F.row_number().over(W.partitionBy("fp").orderBy("h"))).where("n = 1").select("row.*"))
    return out
