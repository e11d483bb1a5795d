"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products.

1. Equal vectors of a label become one, with a weight (grouped, so that a vector
   which a third of all rows share is one row).
2. A label with more than ``local_rows`` vectors has cells: centroids of a
   spherical k-means, as many as its share of all vectors asks for
   (``cell_rows`` vectors a cell, at most ``most_cells`` in all), fitted on a
   bounded sample.  Every vector is assigned to its nearest centroid.
3. Two unit vectors with cosine c are sqrt(2 - 2c) apart; a vector farther than
   that from the plane between two cells can have no partner beyond it, so it
   visits each earlier cell whose plane is as near, and every pair is compared in
   exactly one cell: no link is lost.  (How many cells are visited depends on the
   data; in the worst case all of the label.)
4. A cell (or label) of at most ``local_rows`` vectors goes to one task, which has
   k-means cells of its own within it, by the same rule, and compares each by a
   matrix product in double precision.  A larger one is dealt into blocks of
   ``block`` rows; one task compares two blocks.  What a task returns is, for each
   vector, the weight of its partners and the smallest member of its class among
   the task's vectors, never the pairs.

The vector with the smallest id of each class of linked vectors is kept.

Edge cases: vectors that are null, zero, or hold null or non-finite components,
and vectors without a label, link with nothing; vectors of one label are
compared only with those of their length; rows with the same vec_id and vector
are links of each other; a null vec_id takes part, but a class with null ids
only has a null component; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import drop, saved


def _usable(c: str) -> str:
    return (
        f"{c} is not null and label is not null and size({c}) > 0 and forall({c}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        f" and exists({c}, x -> x <> 0)"
    )


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first so that squares neither vanish nor overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit rows; fewer than k if rows coincide."""
    rng = np.random.default_rng(11)
    c = np.unique(x[rng.choice(len(x), size=min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums, order = np.zeros_like(c), np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) != 0)))
        sums[at[order][starts]] = np.add.reduceat(x[order], starts, axis=0)
        norm = np.sqrt((sums * sums).sum(1))
        c = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-300)[:, None], c)
    return np.unique(c, axis=0)


def visited(x: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every unit row, and for every row and centroid whether the row is compared in that cell."""
    gap = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    sim = x @ c.T
    home = sim.argmax(1)
    at = np.arange(len(x))
    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-18))[home]
    visits = ((sim[at, home][:, None] - sim) / apart <= gap) & (np.arange(len(c))[None] < home[:, None])
    visits[at, home] = True
    return home, visits


def fit_cells(vectors: DataFrame, local_rows: int, cell_rows: int, sample: int, most_cells: int) -> dict[tuple[int, int], np.ndarray]:
    """Centroids for each (label, length) with more than ``local_rows`` vectors.

    At most ``sample`` vectors, those with the smallest hashes, reach the driver in all, and no more centroids than
    ``most_cells`` and a quarter of the sample, shared among the labels by their sizes."""
    large = vectors.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > local_rows)
    # beyond most_cells such labels the smaller ones stay whole and are compared by blocks
    sizes = {(r["label"], r["dim"]): r["n"] for r in large.orderBy(F.col("n").desc(), "label", "dim").limit(most_cells).collect()}
    if not sizes:
        return {}
    picked = vectors.join(large.select("label", "dim"), ["label", "dim"]).select("label", "dim", "v").orderBy(F.xxhash64("v")).limit(sample).toArrow()
    label, dim = picked.column("label").to_numpy(), picked.column("dim").to_numpy()
    flat = picked.column("v").combine_chunks()
    scale = min(1.0, most_cells / sum(math.ceil(n / cell_rows) for n in sizes.values()))
    out = {}
    for key, n in sizes.items():
        own = flat.take(np.flatnonzero((label == key[0]) & (dim == key[1])))
        k = min(max(2, int(scale * math.ceil(n / cell_rows))), len(own) // 4)
        if k > 1:
            c = centroids(unit(own.flatten().to_numpy().reshape(-1, key[1])), k)
            out[key] = c
    return out


def _assigned(vectors: DataFrame, cells: dict, least: float) -> DataFrame:
    """(id, w, v, cell, own): a row for the home cell and for each visited one."""
    sent = vectors.sparkSession.sparkContext.broadcast(cells)  # at most most_cells centroids and no more than a quarter of the sample
    names = [f.name for f in vectors.schema]

    def run(frames):
        for pdf in frames:
            for (label, dim), part in pdf.groupby(["label", "dim"], sort=False):
                c = sent.value.get((int(label), int(dim)))
                if c is None:
                    yield part.assign(cell=f"{label}/{dim}", own=True)[[*names, "cell", "own"]]
                    continue
                for k in range(0, len(part), step := max(1, 2_000_000 // len(c))):
                    some = part.iloc[k : k + step]
                    home, visits = visited(unit(np.array(some["v"].tolist(), "f8")), c, least)
                    row, cell = np.nonzero(visits)
                    out = some.iloc[row].copy()
                    out["cell"] = [f"{label}/{dim}/{j}" for j in cell]
                    out["own"] = cell == home[row]
                    yield out[[*names, "cell", "own"]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInPandas(run, f"{kinds}, cell string, own boolean")


def _classes(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of n nodes with links (i, j), the smallest node of each one's class."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        nxt = label.copy()
        np.minimum.at(nxt, i, low)
        np.minimum.at(nxt, j, low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            break
        label = nxt
    return label


def _within(pdf: pd.DataFrame, least: float, cell_rows: int) -> pd.DataFrame:
    """A whole cell, by k-means cells within it."""
    pdf = pdf.sort_values("id", kind="stable")
    x, w, own, ids = unit(np.array(pdf["v"].tolist(), "f8")), pdf["w"].to_numpy("f8"), pdf["own"].to_numpy(bool), pdf["id"].to_numpy("i8")
    home, visits = visited(x, centroids(x, max(2, math.ceil(len(x) / cell_rows))), least)
    n, left, right = np.zeros(len(x)), [], []
    for cell in range(visits.shape[1]):
        at = np.flatnonzero(visits[:, cell])
        here = home[at] == cell
        links = (x[at] @ x[at].T >= least) & (here[:, None] | here[None]) & (own[at][:, None] | own[at][None])
        np.fill_diagonal(links, False)
        n[at] += links @ w[at]
        i, j = np.nonzero(np.triu(links))
        left.append(at[i])
        right.append(at[j])
    label = _classes(len(x), np.concatenate(left), np.concatenate(right))
    hit = n > 0
    return pd.DataFrame({"id": ids[hit], "n": n[hit].astype("i8"), "root": ids[label[hit]]})


def _compare(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """One pair of blocks of a cell."""
    pdf = pdf.sort_values("id", kind="stable")
    b = pdf["block"].to_numpy()
    first = b == pdf["mine"].iloc[0]
    x, w, own = unit(np.array(pdf["v"].tolist(), "f8")), pdf["w"].to_numpy("f8"), pdf["own"].to_numpy(bool)
    both = pdf["mine"].iloc[0] == pdf["other"].iloc[0]
    left = np.arange(len(x)) if both else np.flatnonzero(first)
    right = np.arange(len(x)) if both else np.flatnonzero(~first)
    links = (x[left] @ x[right].T >= least) & (own[left][:, None] | own[right][None])
    if both:
        np.fill_diagonal(links, False)
    n = np.zeros(len(x))
    n[left] += links @ w[right]
    if not both:
        n[right] += links.T @ w[left]
    i, j = np.nonzero(links)
    label = _classes(len(x), left[i], right[j])
    hit = n > 0
    ids = pdf["id"].to_numpy("i8")
    return pd.DataFrame({"id": ids[hit], "n": n[hit].astype("i8"), "root": ids[label[hit]]})


def near_duplicates(
    vectors: DataFrame, least: float = 0.93, local_rows: int = 2048, cell_rows: int = 1024, block: int = 2048, sample: int = 40_000,
    most_cells: int = 8192, local_cell_rows: int = 128,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "label", F.expr(f"case when {_usable('embedding')} then transform(embedding, x -> cast(x as double)) end").alias("v"))
    rows = rows.withColumn("label", F.col("label").cast("long"))
    usable = rows.where("v is not null")
    distinct = usable.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")).withColumn("dim", F.size("v"))
    # a number for each distinct vector: ids may be null or stand for several vectors
    distinct, path = saved(distinct.withColumn("id", F.monotonically_increasing_id()), "vectors")
    cells = fit_cells(distinct, local_rows, cell_rows, sample, most_cells)
    placed, placed_path = saved(_assigned(distinct.select("id", "w", "label", "dim", "v"), cells, least).drop("label", "dim"), "cells")
    p = placed.join(placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "cell")
    small = p.where(F.col("n") <= local_rows).groupBy("cell").applyInPandas(lambda pdf: _within(pdf, least, local_cell_rows), "id long, n long, root long")
    p = p.where(F.col("n") > local_rows).withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    # row of block b goes to the pairs (b, other) and (other, b)
    p = p.withColumn("with", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)"))).select(
        "cell", F.least("block", "with").alias("mine"), F.greatest("block", "with").alias("other"), "block", "id", "w", "v", "own"
    )
    large = p.groupBy("cell", "mine", "other").applyInPandas(lambda pdf: _compare(pdf, least), "id long, n long, root long")
    found, found_path = saved(small.union(large), "partners")
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(found.select("id", "root"))
    reps = distinct.select("id", "label", "v", "rep", "w").join(linked, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
    reps = reps.withColumn("class", F.coalesce("component", "id"))
    low = reps.groupBy("class").agg(F.min("rep").alias("low"))
    reps, _ = saved(
        reps.join(low, "class").select("label", "v", F.col("low").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")), "classes"
    )
    drop(vectors.sparkSession, path, placed_path, found_path)
    joined = usable.join(reps, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
