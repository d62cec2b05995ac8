"""Files that tasks write into, and read from, the folder all executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow.fs as pafs


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder as Spark names it, and the path on it. ``file:/x`` and ``file:///x`` are the same."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def committed(folder: str, name: str) -> Iterator[Any]:
    """A stream to ``folder/name`` that appears only when complete.

    Each attempt of a task writes a file of its own and then moves it over the final name, so a
    repeated or speculative attempt replaces equal bytes by equal bytes.
    """
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    trial = f"{root}/.{name}-{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(trial) as out:
            yield out
        fs.move(trial, f"{root}/{name}")
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(trial)
        raise
