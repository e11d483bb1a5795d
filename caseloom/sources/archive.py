"""Export archives: zip files by tenant, written and read as a data source.

Rows (tenant, volume, entry, seq, content) that come to a task in the order of
tenant, volume, entry and seq become a zip file for each tenant and volume; rows
of one entry are put together in it.  An entry is written as it comes, so a task
holds one row.  Files are staged under the number of their write; its manifest,
written when all tasks have ended, says which of them count, so a task that is
run again leaves neither duplicates nor orphans: the write's other files are
deleted, and a reader never takes a file that no manifest lists.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
import zipfile
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .byte_streams import opened

SCHEMA = "tenant string, volume int, entry string, seq long, content binary"


@dataclasses.dataclass
class _Made(WriterCommitMessage):
    files: list[tuple[str, str, int]]  # (file, tenant, volume)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.number = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        made, at, name, out, entry, sink = [], None, None, None, None, None

        def close(whole: bool) -> None:
            if sink is not None:
                sink.close()
            if whole and out is not None:
                out[0].close()
                out[1].close()

        for r in iterator:
            if (r["tenant"], r["volume"]) != at:
                close(True)
                at, entry, sink = (r["tenant"], r["volume"]), None, None
                name = f"{self.number}-{uuid.uuid4().hex}.zip"
                file = system.open_output_stream(f"{path}/{name}", compression=None)
                out = (zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED), file)
                made.append((name, *at))
            if r["entry"] != entry:
                close(False)
                entry = r["entry"]
                info = zipfile.ZipInfo(entry)
                info.compress_type = zipfile.ZIP_DEFLATED
                sink = out[0].open(info, "w", force_zip64=True)
            sink.write(bytes(r["content"] or b""))
        close(True)
        return _Made(made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        listed = sorted(f for m in messages if m is not None for f in m.files)
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        part = f"{path}/{self.number}.part"
        with system.open_output_stream(part, compression=None) as out:
            out.write(json.dumps(listed).encode())
        system.move(part, f"{path}/{self.number}.manifest")
        self._clear({f[0] for f in listed})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(set())

    def _clear(self, kept: set[str]) -> None:
        system, path = opened(self.path)
        for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if x.base_name.startswith(f"{self.number}-") and x.base_name not in kept:
                system.delete_file(x.path)


class _Volume(InputPartition):
    def __init__(self, file: str, tenant: str, volume: int):
        self.file, self.tenant, self.volume = file, tenant, volume


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        system, path = opened(self.path)
        out = []
        for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if x.base_name.endswith(".manifest"):
                with system.open_input_file(x.path) as f:
                    out += [_Volume(*row) for row in json.loads(f.read())]
        return out or [_Volume(None, None, None)]

    def read(self, partition: _Volume) -> Iterator[tuple]:
        if partition.file is None:
            return
        system, path = opened(self.path)
        with system.open_input_file(f"{path}/{partition.file}") as f, zipfile.ZipFile(f) as z:
            for k, name in enumerate(z.namelist()):
                yield partition.tenant, partition.volume, name, k, z.read(name)


class Archives(DataSource):
    """``format("caseloom_archive").option("path", folder)``, to write and to read (an entry is one row then)."""

    @classmethod
    def name(cls) -> str:
        return "caseloom_archive"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def write(entries: DataFrame, path: str, volume_bytes: int = 1 << 30) -> None:
    """Writes entries (tenant, entry, seq, content); a tenant has a volume for every ``volume_bytes`` or so.

    Entries go to volumes by the hash of their names, so that the largest tenant is as many tasks as it has volumes."""
    spark = entries.sparkSession
    spark.dataSource.register(Archives)
    e = entries.select(F.coalesce(F.col("tenant").cast("string"), F.lit("")).alias("tenant"), "entry", F.col("seq").cast("long").alias("seq"), "content")
    sizes = e.groupBy("tenant").agg(F.ceil(F.sum(F.coalesce(F.octet_length("content"), F.lit(0))) / volume_bytes).alias("n"))
    e = e.join(sizes, "tenant").withColumn("volume", F.pmod(F.xxhash64("entry"), F.greatest("n", F.lit(1))).cast("int"))
    dealt = e.repartition("tenant", "volume").sortWithinPartitions("tenant", "volume", "entry", "seq").select("tenant", "volume", "entry", "seq", "content")
    dealt.write.format("caseloom_archive").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Archives)
    return spark.read.format("caseloom_archive").option("path", path).load()
