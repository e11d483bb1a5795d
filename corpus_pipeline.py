"""From raw documents to token shards: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.llm import decontam, mixing, quality, simhash, tokenfile
from caseloom.llm.queries import tokenizer
from caseloom.llm.shared import drop, saved


def whole(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, and the whole row beside them, so that no other column's name can clash."""
    return docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(whole(docs), model, ["row"]).where("score >= 0.3").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id.

    Of rows with that doc_id the one whose text hashes lowest stays.  Rows without a doc_id stay if no
    row with one is in their group, one for each fingerprint.
    """
    return simhash.representatives(docs, bits=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontam.search(whole(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["row"])
    return found.where("size(leaks) = 0").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a slot of the mix holds their first word, in the order of the slots."""
    return mixing.ordered(whole(docs), ("row",)).select("row.*")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards; a row for each document read back from them."""
    manifest, _ = tokenfile.write(docs, tokenizer("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read(spark, manifest)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token ids", tokens_stage),
]

#: The classifier, the fingerprints and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = saved(stage(spark, docs, sf_dir), name.split()[0].lower())
        if last:
            drop(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
