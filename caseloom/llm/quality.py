"""Quality classifier: a support vector machine on Naive Bayes features.

Features are indicators of hashed byte n-grams (1 to 3 bytes, case kept) of the
whole text, and of word n-grams that are one word 2, 3, 4 or 8 times.  Each is scaled by its log-count ratio between the classes, a
document's vector is scaled to unit length, and a linear model with hinge loss
is fitted by dual coordinate descent.  A logistic curve, fitted to margins of
folds that were left out, makes the margin a probability.

The model is fitted on at most ``sample`` labelled rows a class (those with the
smallest hashes of their ids), so its cost on the driver is bounded; scoring
reads every whole text.  A score depends on the text alone.

Edge cases: null texts are empty; an empty text has the bias for a margin;
labels that are null or of unknown documents are ignored; with labels of one
kind every score is that label, with none every score is 0.5; repeated rows are
scored alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import slices

BITS = 16
SIZE = (1 << BITS) + 4
_CHUNK = 1 << 20
_SEEDS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def features(text: bytes) -> np.ndarray:
    """Sorted distinct feature numbers."""
    seen = np.zeros(1 << BITS, bool)
    for k in range(0, max(1, len(text)), _CHUNK):
        b = np.frombuffer(text[k : k + _CHUNK + 2], "u1").astype("u4")
        gram = np.zeros(len(b), "u4")
        for n, seed in enumerate(_SEEDS):
            if len(b) <= n:
                break
            gram = (gram[: len(b) - n] << np.uint32(8)) | b[n:]
            with np.errstate(over="ignore"):
                h = (gram + np.uint32(n + 1)) * np.uint32(seed)
                seen[(h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)] = True
    found = np.flatnonzero(seen).astype("i4")
    words = text.split()
    same = np.fromiter(map(eq, words, words[1:]), "u1", count=max(0, len(words) - 1))
    if same.any():
        run = np.diff(np.flatnonzero(np.concatenate(([1], 1 - same, [1]))))  # lengths of runs of one word
        found = np.concatenate((found, [SIZE - 4 + i for i, n in enumerate((2, 3, 4, 8)) if run.max() >= n])).astype("i4")
    return found


@dataclass
class Model:
    weight: np.ndarray  # of a feature, its ratio included
    square: np.ndarray  # of a feature's ratio
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        if not len(x):
            return self.bias
        return float(self.weight[x].sum() / np.sqrt(self.square[x].sum() + 1e-12)) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -700, 700))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(SIZE, smooth), np.full(SIZE, smooth)
    for x, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[x] += 1
    return np.log(p / (smooth + (y > 0).sum())) - np.log(q / (smooth + (y <= 0).sum()))


def _svm(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, costs: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for hinge loss with a cost for each row. Returns (weights of features, bias)."""
    norms = np.array([np.sqrt((ratio[x] ** 2).sum() + 1e-12) for x in rows])
    alpha, w, bias = np.zeros(len(rows)), np.zeros(SIZE), 0.0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            x = rows[i]
            scaled = ratio[x] / norms[i]
            slope = y[i] * (w[x] @ scaled + bias) - 1
            new = min(max(alpha[i] - slope / (1.0 + (1.0 if len(x) else 0.0)), 0.0), costs[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[x] += step * y[i] * scaled
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def _logistic(margins: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with smoothed targets."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    x, beta = np.stack([margins, np.ones_like(margins)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weights * (t - p)))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, shares: tuple[float, float] | None = None, cost: float = 1.0, epochs: int = 30, folds: int = 3) -> Model:
    """rows: feature numbers; labels: 0 or 1; shares: how often each label is where the model is used."""
    zero = np.zeros(SIZE, "f4")
    if not len(labels) or labels.min() == labels.max():
        return Model(zero, zero, 0.0, 0.0, 0.0 if not len(labels) else (20.0 if labels[0] else -20.0))
    y = np.where(labels > 0, 1.0, -1.0)
    shares = shares or ((y <= 0).mean(), (y > 0).mean())
    weights = np.where(y > 0, shares[1] / (y > 0).mean(), shares[0] / (y <= 0).mean())

    def model(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        chosen, label = [rows[i] for i in use], y[use]
        ratio = log_count_ratios(chosen, label)
        w, bias = _svm(chosen, label, ratio, cost * weights[use], epochs)
        return w * ratio, ratio**2, bias

    fold = np.arange(len(rows)) % folds
    margins = np.zeros(len(rows))
    for k in range(folds):
        use = np.flatnonzero(fold != k)
        if y[use].min() == y[use].max():
            use = np.arange(len(rows))
        m = Model(*model(use), 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margins[i] = m.margin(rows[i])
    slope, shift = _logistic(margins, y, weights)
    w, square, bias = model(np.arange(len(rows)))
    return Model(w.astype("f4"), square.astype("f4"), bias, slope, shift)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featured(df: DataFrame, keep: list[str]) -> DataFrame:
    d = df.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for b in slices(batches):
            x = pa.array([features(t.as_py()) for t in b.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), x], [*keep, "x"])

    return d.mapInArrow(run, ", ".join(f"{c} {dict(d.dtypes)[c]}" for c in keep) + ", x array<int>")


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, **how) -> Model:
    """Learns from at most ``sample`` rows of each label, none of them held out."""
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).select(
        "doc_id", (F.col("quality") > 0).cast("int").alias("y")
    ).distinct()
    picked = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.union(part)
    # at most 2 x sample ids are broadcast
    # of rows with one id the text with the smallest features counts, so that reruns agree
    rows = _featured(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), ["doc_id", "y"]).groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow()
    x = [c[i].values.to_numpy() for c in rows.column("x").chunks for i in range(len(c))]
    y = rows.column("y").to_numpy()
    order = np.lexsort((y, rows.column("doc_id").to_numpy(), rows.column("doc_id").to_numpy() * 2654435761 % 4294967296))
    counts = dict(usable.groupBy("y").count().collect())
    total = sum(counts.values())
    shares = (counts[0] / total, counts[1] / total) if len(counts) == 2 else None
    return fit([x[i] for i in order], y[order], shares, **how)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row and its score."""
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: two arrays of 2^BITS

    def run(batches):
        for b in slices(batches):
            m = sent.value
            s = np.fromiter((m.score(features(t.as_py())) for t in b.column("_text")), "f8", count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], [*keep, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.drop("_text").schema) + ", score double"
    return d.mapInArrow(run, schema)
