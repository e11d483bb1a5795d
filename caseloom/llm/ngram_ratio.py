"""Quality rules: a likelihood ratio of hashed n-grams between trusted documents and the whole corpus.

1. Byte n-grams (one to four bytes) of every whole text are hashed into 2^bits
   buckets and counted twice, over all documents (raw, R in all) and over the
   trusted ones (target, T in all): two multinomials.
2. The ratio of a bucket is log((t + smooth) / (r T/R + smooth)), which is the log
   of the two multinomials' quotient, smoothed so that buckets nobody has seen say
   nothing.  A document's own n-grams are taken from both counts first, so that no
   document vouches for itself.
3. The score is the sum of the ratios of all n-grams of a document over their
   number plus ``neutral``: as if so many n-grams that say nothing stood beside
   them, so that short texts need clear evidence.
4. A document is kept if its base rules hold and its score reaches ``least``; no
   chance is involved.

Counts grow with the corpus up to 2^bits buckets, which is what a task holds and
what reaches the driver; texts are never shuffled unless the trusted ids exceed
``most_broadcast``, when they are joined by shuffle.

Base rules and their figures are those of ``figures()``: words are runs without
ASCII white space, word_chars their code points, n_symbols the characters
``#*$%&|<>``, n_dup_lines the lines with a word that equal an earlier line, and
n_repeat_words the words in windows of five that occur twice or more.

Edge cases: a null text is an empty one; a text without n-grams scores 0 (and
fails for want of words); without trusted documents every score is 0 and the base
rules decide; a trusted id of no document is ignored, a null one too; rows that
repeat an id are documents of their own, each as trusted as its id; texts of any
length are taken in pieces; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import saved, slices

BITS = 18
ORDERS = 4
_PIECE = 1 << 18
_BLOCK = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"


def buckets(text: bytes, bits: int = BITS) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, piece by piece."""
    for k in range(0, len(text), _PIECE):
        b = np.frombuffer(text[k : k + _PIECE + ORDERS - 1], "u1").astype("u8")
        here = min(_PIECE, len(text) - k)  # n-grams begin in the piece, and may end beyond it
        gram, found = np.zeros(len(b), "u8"), []
        for n in range(1, ORDERS + 1):
            if len(b) < n:
                break
            gram = (gram[: len(b) - n + 1] << np.uint64(8)) | b[n - 1 :]
            h = (gram[:here] + np.uint64(n << 40)) * _MIX
            h = (h ^ (h >> np.uint64(32))) * _MIX
            found.append((h >> np.uint64(64 - bits)).astype("i4"))
        yield np.concatenate(found)


def counted(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, how many n-grams of the text) in ascending order."""
    if len(text) <= _PIECE:
        found = next(buckets(text, bits), np.zeros(0, "i4"))
        found.sort()
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(found)), bool), np.diff(found) > 0)))
        return found[starts], np.diff(np.append(starts, len(found)))
    total = np.zeros(1 << bits, "i8")
    for part in buckets(text, bits):
        total += np.bincount(part, minlength=1 << bits)
    found = np.flatnonzero(total)
    return found, total[found]


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal ones."""
    return np.unique(a.astype("i8") * (int(b.max()) + 1) + b, return_inverse=True)[1]


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words in windows of so many words that occur twice or more, the first time included."""
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), "i8", count=len(words))
    if len(seen) == len(words):
        return 0
    two = _ranks(ids[:-1], ids[1:])
    five = _ranks(_ranks(two[:-2], two[2:])[: len(words) - 4], ids[4:]) if window == 5 else _windows(ids, window)
    starts = np.flatnonzero(np.bincount(five)[five] > 1)
    edges = np.zeros(len(words) + 1, "i4")
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def _windows(ids: np.ndarray, window: int) -> np.ndarray:
    out = ids
    for k in range(1, window):
        out = _ranks(out[: len(ids) - k], ids[k:])
    return out


def figures(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def counts(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams of each bucket the documents (text, trusted) hold: of all, and of the trusted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, "i8"), np.zeros(1 << bits, "i8")
        for b in slices(batches):
            for text, trusted in zip(b["text"], b["trusted"], strict=True):
                for part in buckets((text.as_py() or "").encode(), bits):
                    n = np.bincount(part, minlength=1 << bits) if len(part) > 1 << bits else None
                    for into in (raw, target) if trusted.as_py() else (raw,):
                        if n is None:
                            np.add.at(into, part, 1)
                        else:
                            into += n
        for k in range(0, 1 << bits, _BLOCK):
            at = np.flatnonzero(raw[k : k + _BLOCK]).astype("i4") + k
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    parts = docs.select("text", "trusted").mapInArrow(run, "bucket int, raw long, target long")
    found = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # 2^bits rows at most
    raw, target = np.zeros(1 << bits, "i8"), np.zeros(1 << bits, "i8")
    at = found["bucket"].to_numpy()
    raw[at], target[at] = found["raw"].to_numpy(), found["target"].to_numpy()
    return raw, target


def score(text: bytes, trusted: bool, raw: np.ndarray, target: np.ndarray, totals: tuple[int, int], smooth: float, neutral: float, bits: int = BITS) -> float:
    """The length-normalised log-likelihood ratio of a text; what it counts itself is left out."""
    at, n = counted(text, bits)
    if not len(at):
        return 0.0
    own = int(n.sum())
    r_all, t_all = totals[0] - own, totals[1] - own * trusted
    if t_all <= 0 or r_all <= 0:
        return 0.0
    t, r = target[at] - n * trusted, raw[at] - n
    return float(n @ (np.log(t + smooth) - np.log(r * (t_all / r_all) + smooth)) / (own + neutral))


def judge(
    docs: DataFrame, trusted: DataFrame, keys: list[str], least: float = -0.2, smooth: float = 10.0, neutral: float = 200.0, bits: int = BITS, most_broadcast: int = 1_000_000
) -> DataFrame:
    """``keys`` of every document with its figures, base_failed, score and kept; ``trusted`` has the doc_ids to trust."""
    spark = docs.sparkSession
    ids, _ = saved(trusted.where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().withColumn("_trusted", F.lit(True)), "trusted")
    if ids.count() <= most_broadcast:
        ids = F.broadcast(ids)  # some 20 MB at most
    flagged = docs.select(F.struct(*keys).alias("_keys"), F.col("doc_id").alias("_doc"), "text").join(ids, F.col("_doc") == F.col("_id"), "left")
    flagged = flagged.select("_keys", "text", F.coalesce("_trusted", F.lit(False)).alias("trusted"))
    raw, target = counts(flagged, bits)
    totals = int(raw.sum()), int(target.sum())
    sent = spark.sparkContext.broadcast((raw, target))  # two arrays of 2^bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = sent.value
        for b in slices(batches):
            rows = []
            for text, flag in zip(b["text"], b["trusted"], strict=True):
                text = text.as_py() or ""
                f = figures(text)
                s = score(text.encode(), flag.as_py(), raw, target, totals, smooth, neutral, bits)
                failed = base_failed(f[0], f[4])
                rows.append((*f, failed, s, not failed and s >= least))
            made = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b["_keys"], *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=["_keys", *FIGURES])

    schema = f"_keys {flagged.schema['_keys'].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in zip(FIGURES, ["long"] * 5 + ["boolean", "double", "boolean"], strict=True))
    return flagged.mapInArrow(run, schema).select("_keys.*", *FIGURES)


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def trusted_of(labels: DataFrame) -> DataFrame:
    """doc_ids whose labels all say quality 1 and none toxic."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("doc_id")
