"""What an office's export holds: its rows as lines of JSON, its documents under a cap, and a note for each that is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import folds

CAP = 200 * 1024 * 1024
# Notes of documents that an export does not hold, old storage, and the characters of entries' names.
NO_FILE, OLD_FILE, LOST_FILE, NO_ROOM = "no file attached", "legacy storage path — file not bundled", "file not found on disk", "not embedded — export size cap reached"
OLD_STORAGE = "/uploads/"
ODD = r"[^\w.؀-ۿ-]"
LONGEST = 150


def entry_name(id_: Column, name: Column) -> Column:
    return F.concat(F.lit("documents/"), F.substring(F.regexp_replace(F.concat(id_.cast("string"), F.lit("-"), F.coalesce(name, F.lit(""))), ODD, "_"), 1, LONGEST))


def noted(documents: DataFrame, cap: int = CAP) -> DataFrame:
    """documents (id, tenant, name, url, content, created_at) with file, the entry that holds them, or note, why none does.

    In the order in which they came in, a document is taken if it fits under its tenant's cap; later ones may still fit."""
    state = F.when(F.coalesce(F.col("url"), F.lit("")) == "", NO_FILE).when(F.col("url").startswith(OLD_STORAGE), OLD_FILE).when(F.col("content").isNull(), LOST_FILE)
    d = documents.withColumn("_state", state)
    sized = d.where("_state is null").select("tenant", "id", "created_at", F.octet_length("content").cast("long").alias("_size"))
    fits = folds.packed(sized, "tenant", ["created_at", "id"], "_size", cap).select(F.struct("tenant", "id").alias("_key"), "kept")
    d = d.withColumn("_key", F.struct("tenant", "id")).join(fits, "_key", "left")
    note = F.coalesce("_state", F.when(~F.col("kept"), NO_ROOM))
    return d.select(*documents.columns, F.when(note.isNull(), entry_name(F.col("id"), F.col("name"))).alias("file"), note.alias("note"))


def entries(tables: dict[str, tuple[DataFrame, list[str]]], documents: DataFrame, generated: str, cap: int = CAP) -> DataFrame:
    """(tenant, entry, seq, content) of all tenants' exports: a file of JSON lines a table (tenant, id and the columns named), the documents, their notes and a README."""
    lines = lambda d, entry, columns: d.select("tenant", F.lit(entry).alias("entry"), F.col("id").cast("long").alias("seq"), F.concat(F.to_json(F.struct(*columns)), F.lit("\n")).cast("binary").alias("content"))
    docs = noted(documents, cap)
    out = lines(docs, "documents.json", ["id", "name", "created_at", "file", "note"])
    out = out.unionByName(docs.where("file is not null").select("tenant", F.col("file").alias("entry"), F.lit(0).cast("long").alias("seq"), "content"))
    counts = docs.groupBy("tenant").agg(F.count("*").alias("n"), F.count("file").alias("held")).select("tenant", F.lit("documents").alias("name"), "n", "held")
    for name, (df, columns) in tables.items():
        out = out.unionByName(lines(df, f"{name}.json", columns))
        counts = counts.unionByName(df.groupBy("tenant").agg(F.count("*").alias("n")).select("tenant", F.lit(name).alias("name"), "n", F.lit(None).cast("long").alias("held")))
    said = F.concat(F.lit("  "), F.col("name"), F.lit(".json  "), F.col("n").cast("string"), F.when(F.col("held").isNull(), "").otherwise(F.concat(F.lit(", "), F.col("held").cast("string"), F.lit(" with their file"))))
    texts = counts.groupBy("tenant").agg(F.array_join(F.array_sort(F.collect_list(said)), "\n").alias("said"))  # a line a table
    readme = F.concat(F.lit("Office data export\nOffice:     "), F.coalesce(F.col("tenant").cast("string"), F.lit("")), F.lit(f"\nGenerated:  {generated}\n\n"), F.col("said"), F.lit("\n"))
    return out.unionByName(texts.select("tenant", F.lit("README.txt").alias("entry"), F.lit(0).cast("long").alias("seq"), readme.cast("binary").alias("content")))
