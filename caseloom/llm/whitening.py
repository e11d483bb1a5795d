"""Whitening of embeddings by the eigenvectors of their covariance (cyclic Jacobi).

1. Vectors become whole numbers, x = floor(1024 c) + 100000, so that their number
   n and the sums S of each dimension are exact.
2. Every task centres its vectors, x - S/n, and adds up their products: a scatter
   matrix of one row a dimension for each task, summed by dimension.
3. The driver (which holds one matrix of dimension x dimension) turns it with
   symmetric Jacobi rotations, sweep after sweep, until every off-diagonal entry
   is negligible beside the two diagonal ones it stands between, which gives small
   eigenvalues to high relative accuracy.  A sweep is dealt like a tournament:
   each round rotates disjoint pairs at once.
4. The leading eigenvectors over the roots of their eigenvalues are sent to the
   tasks, which whiten every vector.  The covariance of the result is then measured
   in the same way, so that the error is a measurement and not a promise.

Edge cases: vectors that are null or empty, or hold null or non-finite entries,
get no rows; the space has the dimension that most vectors have (the larger one of
two as common), and vectors of another do not lie in it and get none.  Where an
eigenvalue is zero for double precision (fewer vectors than dimensions, constant
ones, a single one) the component's whitened values are null, and it does not
count for the error, which is null if no component is left; explained is null if
nothing varies.  Equal vectors, repeated and null ids are rows of their own.
deviation is null where it exceeds a long.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import drop, saved, slices

SCALE, OFFSET = 1024, 100_000


def jacobi(a: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by cyclic Jacobi rotations."""
    a = np.array(a, "f8")
    d = len(a)
    v = np.eye(d)
    m = d + d % 2
    ring = np.arange(1, m)
    tiny, least = np.finfo("f8").eps, np.finfo("f8").tiny
    for _ in range(most):
        turned = False
        for k in range(m - 1):
            seats = np.concatenate(([0], np.roll(ring, k)))
            p, q = np.minimum(seats[: m // 2], seats[m // 2 :][::-1]), np.maximum(seats[: m // 2], seats[m // 2 :][::-1])
            p, q = p[q < d], q[q < d]
            apq, app, aqq = a[p, q], a[p, p], a[q, q]
            needed = np.abs(apq) > np.maximum(tiny * np.sqrt(np.abs(app)) * np.sqrt(np.abs(aqq)), least)
            if not needed.any():
                continue
            turned = True
            p, q, apq, app, aqq = p[needed], q[needed], apq[needed], app[needed], aqq[needed]
            with np.errstate(over="ignore"):
                tau = (aqq - app) / (2 * apq)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            cols_p, cols_q = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            # what a rotation does to its own block, without rounding
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            v_p, v_q = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * v_p - s * v_q, s * v_p + c * v_q
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


class Space(NamedTuple):
    """A fitted space: eigenvalues falling, eigenvectors as columns, the share of each in all variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]

    def matrix(self, components: int) -> np.ndarray:
        """dimension x components: what a centred vector is multiplied by; columns of NaN where the eigenvalue is zero."""
        e = self.values[:components]
        known = e > len(self.values) * np.finfo("f8").eps * max(self.values[0], 0.0)
        return np.where(known, self.vectors[:, :components] / np.sqrt(np.where(known, e, 1.0)), np.nan)


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the usable vectors, of whatever dimension; floor(1024 c) is cut to what a long holds."""
    usable = "embedding is not null and size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))"
    whole = f"transform(embedding, c -> cast(greatest(least(floor(cast(c as double) * {SCALE}), 9000000000000000000), -9000000000000000000) as long) + {OFFSET})"
    return vectors.where(usable).select("vec_id", F.expr(whole).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _fits(x: np.ndarray, n: int) -> bool:
    """Whether n x - S, and sums of as many x, stay well within a long."""
    return len(x) == 0 or 4 * n * max(int(x.max()), -int(x.min()), 1) < 1 << 62


def sums(x: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sums of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in slices(batches):
            m = _matrix(b["x"], d)
            n += len(m)
            part = m.sum(axis=0) if _fits(m, len(m)) else m.astype(object).sum(axis=0)
            total = [a + int(c) for a, c in zip(total, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * d, pa.int64()), pa.array(range(d), pa.int32()), pa.array([str(v) for v in total])], names=["n", "at", "part"])

    parts = x.select("x").mapInArrow(run, "n long, at int, part string").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    found = {r["at"]: r for r in parts.collect()}  # a row a dimension
    return (found[0]["n"], [int(found[i]["s"]) for i in range(d)]) if found else (0, [0] * d)


def _shifted(m: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exact: of longs where they hold it, else of Python's."""
    if _fits(m, n):
        return m * n - np.array(total, "i8")
    return m.astype(object) * n - np.array(total, object)


def centred(m: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n; the difference is taken before it is rounded."""
    return _shifted(m, n, total).astype("f8") / n


def scatter(rows: DataFrame, d: int, centre) -> np.ndarray:
    """The sum of products of centred rows; centre(batch) gives them as a matrix with d columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, d)), False
        for b in slices(batches):
            y = centre(b)
            total += y.T @ y
            some = True
        for i in range(d if some else 0):  # row by row, so that no record holds a matrix
            yield pa.RecordBatch.from_arrays([pa.array([i] * (d - i), pa.int32()), pa.array(range(i, d), pa.int32()), pa.array(total[i, i:])], names=["i", "j", "p"])

    out = np.zeros((d, d))
    for r in rows.mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).toLocalIterator():  # d (d + 1) / 2 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["p"]
    return out


def fit(x: DataFrame, d: int) -> Space:
    """The space of the vectors (x array<long>, all of dimension d)."""
    n, total = sums(x, d)
    v = scatter(x.select("x"), d, lambda b: centred(_matrix(b["x"], d), n, total)) / max(n, 1)
    values, vectors = jacobi(v)
    # either sign is an eigenvector: the largest entry is positive here
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
    trace = float(np.trace(v))
    return Space(n, total, values, vectors, [float(e) / trace if trace > 0 else None for e in values])


def whitened(x: DataFrame, space: Space, components: int) -> DataFrame:
    """(vec_id, deviation, w array<double>): each vector's squared deviation, exact, and its whitened components."""
    n, total, d = space.n, space.sums, len(space.sums)
    sent = x.sparkSession.sparkContext.broadcast(space.matrix(components))  # dimension x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            m = _matrix(b["x"], d)
            y = _shifted(m, n, total)
            wide = y.dtype == object or (len(y) and int(np.abs(y).max()) ** 2 * d >= 1 << 63)
            squares = (y.astype(object) ** 2).sum(axis=1) if wide else (y * y).sum(axis=1)
            squares = [int(s) if s < 1 << 63 else None for s in squares]
            w = y.astype("f8") / n @ sent.value
            values = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype="i4")), values)
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(squares, pa.int64()), arrays], names=["vec_id", "deviation", "w"])

    kind = x.schema["vec_id"].dataType.simpleString()
    return x.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")


def identity_error(rows: DataFrame, n: int, known: list[int]) -> float | None:
    """The largest entry of the covariance of w (its known components) minus the identity."""
    if not known:
        return None
    means = rows.agg(*[(F.sum(F.col("w")[k]) / n).alias(f"m{k}") for k in known]).first()

    def centre(b: pa.RecordBatch) -> np.ndarray:
        w = b["w"].flatten().to_numpy(zero_copy_only=False).reshape(len(b["w"]), -1)
        return w[:, known] - np.array(means, "f8")

    cov = scatter(rows.select("w"), len(known), centre) / n
    return float(np.abs(cov - np.eye(len(known))).max())


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    x, path = saved(integers(vectors).withColumn("d", F.size("x")), "integers")
    dims = x.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if dims is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    d = dims["d"]
    x = x.where(F.col("d") == d).select("vec_id", "x")
    space, k = fit(x, d), min(components, d)
    rows, _ = saved(whitened(x, space, k), "whitened")
    known = [i for i in range(k) if not np.isnan(space.matrix(k)[0, i])]
    error = identity_error(rows, space.n, known)
    drop(spark, path)
    explained = F.array(*[F.lit(e).cast("double") for e in space.explained[:k]])
    out = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(space.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
