"""Files in the shared folder, from executors: any scheme that pyarrow knows.

A file is written under a name of its own attempt and moved to its place when
it is whole, so a task that is run twice, or lost half way, leaves no torn file.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def _split(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def writing(uri: str) -> Iterator:
    system, path = _split(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part, compression=None) as out:
            yield out
        system.move(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(part)
        raise


def reading(uri: str):
    """A seekable file."""
    system, path = _split(uri)
    return system.open_input_file(path)


def files(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files with that suffix in a folder, by name."""
    system, path = _split(uri)
    base = uri.rstrip("/")
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f"{base}/{x.base_name}", x.size) for x in found if x.is_file and x.base_name.endswith(suffix))


def delete(uri: str) -> None:
    """A file that may be gone already."""
    system, path = _split(uri)
    with contextlib.suppress(FileNotFoundError):
        system.delete_file(path)
