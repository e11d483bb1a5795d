"""A Merkle manifest of a dataset: one digest for all rows, and a proof for each row.

The rows of a group (a language, say) are the leaves of a tree, in the order of
their key; every ``arity`` consecutive nodes of a level, fewer at its end, become
the digest of their digests, until one is left.  The groups' roots, in the order
of the groups, are the leaves of the tree above them, whose root stands for the
dataset.

How a sibling run is known to be complete: the number of leaves of each group is
counted first, so a run's arity follows from level and index alone.  A *sparse
forest* is a set of nodes keyed by (group, level, index) whose runs are not
complete yet; two forests are merged by putting their nodes together and closing
every run that is complete then.  That is associative and commutative, and the
forest of all rows is the root.

1. Leaves are hashed by built-in functions, written without their texts, ordered
   by group and key over range partitions and written again with their places.
2. A partition's leaves are a run of neighbours, so its forest has at most
   arity - 1 nodes at either end of each level.  Neighbouring forests are merged
   in a tree of rounds (``fan`` at a time, each round a written table); Spark's own
   treeReduce merges distant partitions, whose forests would grow until the end.
3. A row's proof holds the siblings of its path.  Most lie within the row's
   partition and are hashed again there; for the others each partition asks for
   those of its first and its last leaf, a few a level, by a join.

No task holds more than a partition's digests (``part_rows``), nothing but counts
and the root reaches the driver, and a group's size does not matter.

Edge cases: null and empty values have digests of their own ("-" and "0:"); a
null group is a group, the first one; rows with the same key are ordered by their
digests, null keys first, and equal rows are leaves of their own; a group of one
row has that leaf as its root; a table without rows gives no rows and its root is
null.  Columns that are not named do not matter, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from .shared import drop, saved

#: The group of the tree over the groups' roots.
TOP = -1
_NODE = "frag long, g long, n long, level int, idx long, digest string, fresh boolean, open boolean"
_PROOF = "level int, digests array<string>, place int"


def parent(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 length, a colon and itself; "-" if null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def width(n: int, level: int, arity: int) -> int:
    """Nodes of a level of a tree with n leaves."""
    for _ in range(level):
        n = -(-n // arity)
    return n


class Forest:
    """Nodes whose sibling runs are not complete; ``arity`` is that of complete runs."""

    def __init__(self, arity: int, groups: int):
        self.arity, self.groups = arity, groups
        self.n: dict[int, int] = {TOP: groups}
        self.nodes: dict[tuple[int, int], dict[int, str]] = defaultdict(dict)

    def add(self, g: int, n: int, level: int, idx: int, digest: str) -> None:
        self.n[g] = n
        self.nodes[g, level][idx] = digest

    def close(self) -> Iterator[tuple[int, int, int, str]]:
        """Closes all complete runs, lowest levels first; yields the nodes that come of it as (group, level, index, digest)."""
        highest: dict[int, int] = defaultdict(int)
        for g, level in self.nodes:
            highest[g] = max(highest[g], level)
        for g in [*sorted(k for k in highest if k != TOP), TOP]:
            level, most = 0, highest[g]
            while level <= most:
                found = self.nodes.get((g, level))
                across = width(self.n[g], level, self.arity)
                if found and across > 1:
                    for p in sorted({i // self.arity for i in found}):
                        run = range(p * self.arity, min(p * self.arity + self.arity, across))
                        if all(i in found for i in run):
                            digest = parent([found.pop(i) for i in run])
                            self.nodes[g, level + 1][p] = digest
                            most = max(most, level + 1)
                            yield g, level + 1, p, digest
                elif found and g != TOP:  # the group's root is a leaf of the tree above
                    self.nodes[TOP, 0][g] = found.pop(0)
                    yield TOP, 0, g, self.nodes[TOP, 0][g]
                level += 1

    def rows(self) -> Iterator[tuple[int, int, int, str]]:
        for (g, level), found in self.nodes.items():
            for i, digest in found.items():
                yield g, level, i, digest


def _forest_rows(frag: int, forest: Forest, fresh: list[tuple]) -> pd.DataFrame:
    """Rows of _NODE: what is open, and what is new and closed already."""
    still = {(g, level, i) for g, level, i, _ in forest.rows()}
    new = {(g, level, i) for g, level, i, _ in fresh}
    out = [(frag, g, forest.n[g], level, i, d, True, (g, level, i) in still) for g, level, i, d in fresh]
    out += [(frag, g, forest.n[g], level, i, d, False, True) for g, level, i, d in forest.rows() if (g, level, i) not in new]
    return pd.DataFrame(out, columns=["frag", "g", "n", "level", "idx", "digest", "fresh", "open"])


def _runs(pdf: pd.DataFrame, spans: pd.DataFrame) -> Iterator[tuple[int, int, int, pd.DataFrame]]:
    """(group, its size, place of the first leaf here, rows in order) of a partition."""
    pdf = pdf.sort_values("seq")
    at = 0
    for s in spans.sort_values("first_seq").itertuples():
        yield int(s.g), int(s.n), int(s.begins), pdf.iloc[at : at + int(s.here)]
        at += int(s.here)


def _local(pdf: pd.DataFrame, spans: pd.DataFrame, arity: int, groups: int) -> tuple[Forest, list[tuple]]:
    forest = Forest(arity, groups)
    for g, n, begins, rows in _runs(pdf, spans):
        forest.n[g] = n
        forest.nodes[g, 0] = dict(zip(range(begins, begins + len(rows)), rows["leaf"], strict=True))
    return forest, list(forest.close())


def _wanted(spans: pd.DataFrame, arity: int, groups: int) -> set[tuple[int, int, int]]:
    """Nodes on or beside the paths of a partition's leaves that do not lie wholly within it."""
    out = set()

    def path(g: int, n: int, a: int, b: int, has_a: int, has_b: int) -> None:
        """Leaves a to b - 1 have their paths here; has_a to has_b - 1 are known here."""
        across, level, size, low, high = n, 0, 1, a, b - 1
        while across > 1:
            for p in {low // arity, high // arity}:
                for i in range(p * arity, min(p * arity + arity, across)):
                    if not (has_a <= i * size and min(i * size + size, n) <= has_b):
                        out.add((g, level, i))
            across, level, size, low, high = -(-across // arity), level + 1, size * arity, low // arity, high // arity

    for s in spans.itertuples():
        path(int(s.g), int(s.n), int(s.begins), int(s.begins + s.here), int(s.begins), int(s.begins + s.here))
    ranks = sorted(int(g) for g in spans["g"])
    whole = sorted(int(s.g) for s in spans.itertuples() if s.here == s.n)
    path(TOP, groups, ranks[0], ranks[-1] + 1, whole[0] if whole else 0, whole[-1] + 1 if whole else 0)
    out |= {(TOP, 0, g) for g in ranks if g not in set(whole)}  # (the groups' roots themselves)
    return out


def fold(digest: str, proof: list[tuple[list[str], int]]) -> str:
    """The root that a leaf's digest and its siblings, level by level with the leaf's place among them, give."""
    for siblings, place in proof:
        digest = parent([*siblings[:place], digest, *siblings[place:]])
    return digest


def _proofs(pdf: pd.DataFrame, spans: pd.DataFrame, outside: pd.DataFrame, arity: int, groups: int) -> Iterator[tuple[pd.DataFrame, list, list]]:
    """For each run of a partition its rows, their groups' root, and a proof for each."""
    known: dict[tuple[int, int], dict[int, str]] = defaultdict(dict)
    for o in outside.itertuples():
        known[int(o.g), int(o.level)][int(o.idx)] = o.digest
    runs = list(_runs(pdf, spans))
    for g, _, begins, rows in runs:
        known[g, 0].update(zip(range(begins, begins + len(rows)), rows["leaf"], strict=True))
    for g, level, i, digest in _local(pdf, spans, arity, groups)[1]:
        known[g, level][i] = digest
    seen: dict[tuple[int, int, int], tuple[list[str], int]] = {}

    def step(g: int, across: int, level: int, i: int) -> tuple[list[str], int]:
        if (found := seen.get((g, level, i))) is None:
            first = i - i % arity
            run, at = range(first, min(first + arity, across)), known[g, level]
            found = seen[g, level, i] = ([at[j] for j in run if j != i], i - first)
        return found

    def path(g: int, n: int, i: int) -> list[tuple[list[str], int]]:
        out, level = [], 0
        while n > 1:
            out.append(step(g, n, level, i))
            n, level, i = -(-n // arity), level + 1, i // arity
        return out

    for g, n, begins, rows in runs:
        above = path(TOP, groups, g)
        yield rows, known[TOP, 0][g], [path(g, n, i) + above for i in range(begins, begins + len(rows))]


class Manifest(NamedTuple):
    """A built manifest: leaves in place, the runs of groups a partition, the nodes that cross partitions, the root."""

    leaves: DataFrame
    spans: DataFrame
    nodes: DataFrame
    root: str | None
    groups: int
    arity: int
    paths: tuple[str, ...]

    def proofs(self, check: bool = False, wide: bool = True) -> DataFrame:
        """Every leaf with its group's root and its proof, and what the proof folds to.

        (group, key, leaf, other, subroot, proof_sha256, folded_root), and with ``wide`` the proof itself as an array
        of (level, digests of the siblings, the leaf's place among them).  With ``check`` the fold begins at ``other``
        where that is not null: a leaf hashed anew, of a row that may have been changed."""
        arity, groups = self.arity, self.groups
        kinds = [f.dataType for f in self.leaves.select("grp", "key").schema]
        out = f"grp {kinds[0].simpleString()}, key {kinds[1].simpleString()}, leaf string, other string, subroot string, proof_sha256 string, folded_root string"
        out += f", proof array<struct<{_PROOF.replace(' ', ': ', 1).replace(', digests ', ', digests: ').replace(', place ', ', place: ')}>>" if wide else ""

        def ask(spans: pd.DataFrame) -> pd.DataFrame:
            part = spans["part"].iloc[0]
            return pd.DataFrame([(part, *x) for x in _wanted(spans, arity, groups)], columns=["part", "g", "level", "idx"])

        wanted = self.spans.groupBy("part").applyInPandas(ask, "part long, g long, level int, idx long")
        outside = wanted.join(self.nodes.select("g", "level", "idx", "digest"), ["g", "level", "idx"])
        # two sides, so one frame a partition: leaves, spans and asked nodes, told apart by kind
        given = self.spans.select("part", F.lit(0).alias("kind"), F.lit(0).alias("level"), F.lit("").alias("digest"), "g", "n", F.col("begins").alias("idx"), "here", "first_seq")
        given = given.unionByName(outside.select("part", F.lit(1).alias("kind"), "level", "digest", "g", "idx"), allowMissingColumns=True)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            pdf, more = left.to_pandas(types_mapper=pd.ArrowDtype), right.to_pandas()
            here = more[more["kind"] == 0].rename(columns={"idx": "begins"})
            rows = []
            for part, subroot, proofs in _proofs(pdf, here, more[more["kind"] == 1], arity, groups):
                for r, proof in zip(part.itertuples(index=False), proofs, strict=True):
                    start = r.other if check and isinstance(r.other, str) else r.leaf
                    digest = sha256("".join(d for siblings, _ in proof for d in siblings).encode()).hexdigest()
                    row = [r.seq, r.leaf, subroot, digest, fold(start, proof)]
                    rows.append((*row, [{"level": k, "digests": s, "place": p} for k, (s, p) in enumerate(proof)]) if wide else row)
            names = ["seq", "leaf", "subroot", "proof_sha256", "folded_root", *["proof"] * wide]
            made = {k: [r[i] for r in rows] for i, k in enumerate(names)}
            left = left.take(pc.sort_indices(left, sort_keys=[("seq", "ascending")]))
            columns = [left["grp"], left["key"], left["leaf"], left["other"], *(pa.array(made[k]) for k in names[2:5])]
            if wide:
                columns.append(pa.array(made["proof"], pa.list_(pa.struct([("level", pa.int32()), ("digests", pa.list_(pa.string())), ("place", pa.int32())]))))
            return pa.table(columns, names=["grp", "key", "leaf", "other", "subroot", "proof_sha256", "folded_root", *["proof"] * wide])

        return self.leaves.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(run, out)

    def drop(self) -> None:
        drop(self.leaves.sparkSession, *self.paths)


def build(leaves: DataFrame, arity: int = 2, part_rows: int = 50_000, fan: int = 16) -> Manifest:
    """The manifest of ``leaves`` (grp, key, leaf, and other: a digest to check instead, or null).

    ``part_rows`` leaves or so share a partition; ``fan`` neighbouring forests are merged at a time."""
    if arity < 2 or fan < 2:
        raise ValueError("arity and fan are two at least")
    spark = leaves.sparkSession
    plain, plain_path = saved(leaves.select("grp", "key", "leaf", "other"), "leaves")
    parts = max(1, math.ceil(plain.count() / part_rows))
    # equal rows are leaves that nothing tells apart: their number as they are read does, so that many of them are dealt too
    dealt = plain.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, F.asc_nulls_first("grp"), F.asc_nulls_first("key"), F.asc("leaf"), F.asc("tie"))
    dealt = dealt.sortWithinPartitions(F.asc_nulls_first("grp"), F.asc_nulls_first("key"), "leaf", "tie").withColumn("id", F.monotonically_increasing_id())
    placed, placed_path = saved(
        dealt.select("grp", "key", "leaf", "other", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("seq")), "placed"
    )
    drop(spark, plain_path)
    # one row for each partition and group in it
    s = placed.groupBy("part", "grp").agg(F.min("seq").alias("first_seq"), F.count("*").alias("here"))
    own = W.partitionBy("grp")
    s = s.withColumn("n", F.sum("here").over(own)).withColumn("first_part", F.min("part").over(own))
    s = s.withColumn("begins", F.sum("here").over(own.orderBy("part")) - F.col("here"))
    # a group's number: groups that begin in earlier partitions, and earlier in its own
    begun = s.where("part = first_part").groupBy("part").agg(F.count("*").alias("starts"))
    begun = begun.select(F.col("part").alias("first_part"), (F.sum("starts").over(W.orderBy("part")) - F.col("starts")).alias("before"))  # a row a partition
    heads = s.where("part = first_part").withColumn("_k", F.row_number().over(W.partitionBy("part").orderBy("first_seq"))).join(begun, "first_part")
    heads = heads.select("grp", (F.col("before") + F.col("_k") - 1).alias("g"))
    s = s.withColumn("_g", F.struct("grp")).join(heads.select(F.struct("grp").alias("_g"), "g"), "_g")  # (structs, so that null groups meet)
    spans, spans_path = saved(s.select("part", "g", "n", "begins", "here", "first_seq"), "spans")
    last = spans.agg(F.max("g").alias("g"), F.max("part").alias("part")).first()
    groups, count = (0, 0) if last["g"] is None else (last["g"] + 1, last["part"] + 1)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        here = right.to_pandas()
        frame = _forest_rows(int(here["part"].iloc[0]), _local(left.select(["seq", "leaf"]).to_pandas(), here, arity, groups)[0], [])
        return pa.Table.from_pandas(frame.assign(fresh=True), _schema(), preserve_index=False)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(arity, groups)
        for r in pdf.itertuples():
            forest.add(int(r.g), int(r.n), int(r.level), int(r.idx), r.digest)
        return _forest_rows(int(pdf["frag"].iloc[0]) // fan, forest, list(forest.close()))

    frag, path = saved(placed.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(first, _NODE), "forest")
    rounds, paths = [frag], [path]
    while count > 1:
        frag, path = saved(rounds[-1].where("open").groupBy(F.floor(F.col("frag") / fan)).applyInPandas(merged, _NODE), "forest")
        rounds.append(frag)
        paths.append(path)
        count = -(-count // fan)
    nodes = rounds[0].where("fresh")
    for r in rounds[1:]:
        nodes = nodes.unionByName(r.where("fresh"))
    left = rounds[-1].where("open").limit(2).collect()
    if len(left) > 1:
        raise RuntimeError("the forest did not close")
    return Manifest(placed, spans, nodes, left[0]["digest"] if left else None, groups, arity, (placed_path, spans_path, *paths))


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in _NODE.split(", "))])


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents by lang and doc_id.

    ``other`` is the leaf that a tampered row would have, where 7 divides the CRC-32 of the decimal doc_id: one more
    in n_chars (a null stays null)."""
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    others = [more if c == "n_chars" else F.col(c) for c in FIELDS]
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), leaf(*map(F.col, FIELDS)).alias("leaf"), F.when(tampered, leaf(*others)).alias("other"))


def verified(docs: DataFrame, part_rows: int = 50_000) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document."""
    m = build(document_leaves(docs), part_rows=part_rows)
    return m.proofs(check=True, wide=False).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", F.lit(m.root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(m.root)).alias("verified")
    )


def verify(row: Row, root: str) -> bool:
    """Whether a row of ``proofs()`` proves its leaf."""
    return fold(row["leaf"], [(x["digests"], x["place"]) for x in row["proof"]]) == root
