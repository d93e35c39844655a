"""Files written and read by tasks, on any file system that pyarrow opens by URI."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI; file:/x, file:///x and plain paths are local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def new_file(folder: str, stem: str, suffix: str) -> Iterator[tuple[str, pa.NativeFile]]:
    """(uri, stream) of a file with a name of its own, so that a repeated task never meets its first try's file.

    Readers take names from the manifest that the task returns; files of failed tries stay unread."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        yield uri, out


def random_access(uri: str) -> pa.NativeFile:
    """A local file is mapped to memory, so that Arrow buffers point into it; others are read in ranges."""
    system, path = opened(uri)
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
