"""Growing byte streams as a streaming source with offsets.

A folder has a file for each stream, ``<name>.sse``, to which its sender appends,
and an empty ``<name>.end`` once it is whole.  The offset says of each stream in the
folder how many of its bytes have been planned, so it grows with the streams that
the folder holds; move those that are used up elsewhere.  A partition is a range of
bytes of one file: chunks begin and end anywhere, within a frame or a character.  A
query that is started again reads on from the bytes that its checkpoint names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


class _Range(InputPartition):
    def __init__(self, name: str, start: int, end: int, last: bool):
        self.name, self.start, self.end, self.last = name, start, end, last


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def _found(self) -> dict[str, list]:
        """Every stream's length and whether it has ended."""
        system, path = opened(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        ended = {x.base_name.removesuffix(".end") for x in found if x.base_name.endswith(".end")}
        return {n: [x.size, n in ended] for x in found if x.base_name.endswith(".sse") for n in [x.base_name.removesuffix(".sse")]}

    def initialOffset(self) -> dict:
        return {"streams": "{}"}

    def latestOffset(self) -> dict:
        return {"streams": json.dumps(self._found(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = json.loads(start["streams"]), json.loads(end["streams"])
        out = []
        for name, (size, ended) in now.items():
            seen, was_ended = before.get(name, [0, False])
            if size > seen or (ended and not was_ended):
                out.append(_Range(name, seen, size, ended))
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        system, path = opened(self.path)
        with system.open_input_file(f"{path}/{partition.name}.sse") as f:
            f.seek(partition.start)
            yield partition.name, partition.start, f.read(partition.end - partition.start), partition.last


class ByteStreams(DataSource):
    """``spark.readStream.format("caseloom_bytes").option("path", folder)``: (stream_id, seq, chunk, last)."""

    @classmethod
    def name(cls) -> str:
        return "caseloom_bytes"

    def schema(self) -> str:
        return "stream_id string, seq long, chunk binary, last boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)
