"""Token counts with a digest cache.

A text is normalised in a way that cannot change its count (runs of ASCII white
space become one space, none at the ends; only for tokenizers that drop white
space) and named by the SHA-256 digest of the result.  A cache table holds the
count of each (digest, tokenizer version), the version being the digest of the
tokenizer's file.  Only distinct texts that the cache lacks are encoded, and
their counts are appended to it.

Copies meet in a partial aggregate before anything is shuffled, so a text that
a third of all rows share moves once a task.

Edge cases: null texts are empty (0 bytes, 0 tokens); repeated rows share one
count; an empty table adds nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import new_path, slices

CACHE = "digest binary, version string, n_tokens long"


def version(tokenizer: str) -> str:
    return hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()


def drops_space(tokenizer: str) -> bool:
    """Whether white space between words never becomes a token: the pre-tokenizer keeps matches of a pattern without it only."""
    import json

    if not tokenizer.endswith(".json"):
        return False
    spec = json.loads(Path(tokenizer).read_text())
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))


def normalised(text: Column, spaces: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if spaces else text


def _exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


_COUNTERS: dict = {}


def _count(tokenizer: str, spaces: bool, texts: list[bytes]) -> list[int]:
    if tokenizer not in _COUNTERS:
        if tokenizer.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            _COUNTERS[tokenizer] = lambda ts: [len(x) for x in model.encode([t.decode() for t in ts], num_threads=1)]
        elif spaces:
            from .tokens import Counter

            _COUNTERS[tokenizer] = Counter(tokenizer).count
        else:
            from .tokens import _tokenizer

            _COUNTERS[tokenizer] = lambda ts: [len(x.ids) for x in _tokenizer(tokenizer).encode_batch_fast([t.decode() for t in ts], add_special_tokens=False)]
    return _COUNTERS[tokenizer](texts)


def count(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document.

    ``cache``: folder of the cache table, made if it isn't there (None: a new one).
    """
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token_counts")
    key, spaces = version(tokenizer), drops_space(tokenizer)
    text = normalised(F.col("text"), spaces)
    named = docs.select(text.alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    if _exists(spark, cache):
        stored = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == key)
        named = named.join(stored.select("digest"), "digest", "left_anti")
    misses = named.groupBy("digest").agg(F.max(F.col("text").cast("binary")).alias("text"))

    def run(batches):
        for b in slices(batches):
            n = _count(tokenizer, spaces, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([key] * len(n)), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    misses.mapInArrow(run, CACHE).write.mode("append").parquet(cache)
    # a cache that two runs appended to at once may hold a text twice, with one count
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == key).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    )
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
