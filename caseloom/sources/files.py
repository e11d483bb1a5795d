"""Binary files, uploads, exports and snapshots through Spark's own readers and writers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from .. import tables
from ..functions.data import signature_fits
from ..functions.text import extension, safe_name

MOST_BYTES = 20 * 1024 * 1024
# Extensions and beginnings of media types that uploads may have.
ACCEPTED = ("PDF", "DOC", "DOCX", "XLS", "XLSX", "PNG", "JPG", "JPEG", "TXT")
MEDIA = ("application/pdf", "application/msword", "application/vnd.", "image/png", "image/jpeg", "text/plain")


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content); content is read only if it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def within(files: DataFrame, root: str) -> DataFrame:
    """files with their paths put in order; one outside the root is an error, not a row."""
    path, base = F.regexp_replace("path", "^file:/*", "/"), root.removeprefix("file:").rstrip("/")
    base = "/" + base.lstrip("/") + "/"
    safe = path.startswith(base) & ~path.rlike(r"(^|/)\.\.(/|$)")
    return files.withColumn("path", F.when(safe, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("outside the root: "), path)).cast("string")))


def accepted(files: DataFrame, media: str | None = None) -> DataFrame:
    """files with reason: null for an upload that passes, else the first check that it fails.

    ``media``: the column with the media type that the sender named (none: not checked; blank: passes)."""
    kind = extension(F.element_at(F.split("path", "/"), -1))
    named = F.coalesce(F.col(media), F.lit("")) if media else F.lit("")
    known = F.exists(F.array(*map(F.lit, MEDIA)), lambda m: F.startswith(named, m))
    reason = (
        F.when(F.coalesce(F.col("length"), F.lit(0)) == 0, "empty").when(F.col("length") > MOST_BYTES, "too_large").when(~kind.isin(*ACCEPTED), "extension")
        .when((named != "") & ~known, "media_type").when(~signature_fits(kind, F.col("content")), "content")
    )
    return files.withColumn("reason", reason)


def stored_name(name: Column, id_: Column) -> Column:
    """A unique, safe name for a stored file."""
    return F.concat(id_.cast("string"), F.lit("-"), safe_name(name))


def newest(files: DataFrame) -> DataFrame:
    """The path of the file changed last; equal ones by path."""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def export(tables: dict[str, DataFrame], columns: dict[str, list[str]], path: str) -> DataFrame:
    """Writes each table's allowed columns as JSON lines under path/<name>, and a manifest; returns the manifest (name, n)."""
    chosen = {n: df.select(*columns[n]) for n, df in tables.items()}
    counts = []
    for n, df in chosen.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/{n}")  # counted as it is written
        counts.append((n, seen.get["n"]))
    spark = next(iter(tables.values())).sparkSession
    manifest = spark.createDataFrame(sorted(counts), "name string, n long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def snapshot(df: DataFrame, path: str, day: str) -> None:
    """A dated copy of a table; writing a day again replaces that day only."""
    df.withColumn("snapshot_day", F.lit(day).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_day").parquet(path)


def restored(spark: SparkSession, path: str, day: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("snapshot_day") == F.lit(day).cast("date")).drop("snapshot_day")


def expired(days: DataFrame, day: str, as_of: str, keep_days: int) -> DataFrame:
    """Snapshot days older than the retention."""
    return days.where(F.col(day) < F.date_sub(F.lit(as_of).cast("date"), keep_days))


def pruned(spark: SparkSession, path: str, as_of: str, keep_days: int) -> list[str]:
    """Deletes the snapshot days older than the retention; returns them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    days = [n.partition("=")[2] for x in listed for n in [x.getPath().getName()] if n.startswith("snapshot_day=")]
    oldest = (date.fromisoformat(as_of) - timedelta(days=keep_days)).isoformat()
    gone = sorted(d for d in days if d < oldest)
    for d in gone:
        tables.delete(spark, f"{path}/snapshot_day={d}")
    return gone


def requests(raw: DataFrame, body: str, schema: str) -> DataFrame:
    """JSON bodies parsed; malformed ones have a null request and status 400."""
    return raw.withColumn("request", F.from_json(body, schema, {"mode": "PERMISSIVE"})).withColumn(
        "status", F.when(F.try_parse_json(body).isNull() | F.col("request").isNull(), 400).otherwise(200)
    )
