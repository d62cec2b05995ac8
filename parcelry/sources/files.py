"""File trees: the manifest scan and bounded part reads.

Spark's own file sources hide dot-files, underscore files and empty files, so the tree is
listed directory by directory. Every level is one job over all directories of that depth,
which keeps one deep or wide subtree from falling to a single task. The root must be
mounted on every executor.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.operators.segments import PART_BYTES, part_offsets
from parcelry.session import scratch_path

MANIFEST_SCHEMA = "path string, size bigint, mtime bigint, inside boolean"
LISTING_SCHEMA = "path string, kind string, size bigint, mtime bigint, inside boolean"
LISTING = ["path", "kind", "size", "mtime", "inside"]
LISTING_ROWS = 10_000
TASK_BYTES = 128 * 1024 * 1024


class Tree(NamedTuple):
    """What a scan found: the files, and the directories (path) that could not be read."""

    files: DataFrame
    unreadable: DataFrame


def _list_directories(root: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    base = os.path.realpath(root)
    for pdf in batches:
        for parent in pdf["path"]:
            try:
                entries = list(os.scandir(os.path.join(root, parent)))
            except OSError:
                rows.append((parent, "unreadable", 0, 0, True))
                continue
            for entry in entries:
                path = f"{parent}/{entry.name}" if parent else entry.name
                if entry.is_dir(follow_symlinks=False):
                    rows.append((path, "dir", 0, 0, True))
                elif entry.is_file():
                    inside = not entry.is_symlink() or _is_inside(base, os.path.realpath(entry.path))
                    rows.append((path, "file", *_size_and_time(entry), inside))
                if len(rows) >= LISTING_ROWS:
                    yield pd.DataFrame(rows, columns=LISTING)
                    rows = []
    yield pd.DataFrame(rows, columns=LISTING)


def _is_inside(base: str, target: str) -> bool:
    return target == base or target.startswith(base.rstrip("/") + "/")


def _size_and_time(entry: os.DirEntry) -> tuple[int, int]:
    try:
        facts = entry.stat()
    except OSError:
        return 0, 0
    return facts.st_size, int(facts.st_mtime)


def _slots(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def scan_tree(spark: SparkSession, root: str) -> Tree:
    """Every regular file below ``root``; linked directories are not entered, and ``inside`` tells whether a file's
    target, its links resolved, lies below the root. A directory that cannot be read, or is gone, is reported.

    The width of a level is given, as directories are few bytes and would else be merged into one task.
    """
    frontier = spark.createDataFrame([("",)], "path string")
    levels = []
    while True:
        path = scratch_path(spark, "listing")
        spread = frontier.repartition(4 * _slots(spark), F.col("path")) if levels else frontier
        spread.mapInPandas(lambda batches: _list_directories(root, batches), LISTING_SCHEMA).write.parquet(path)
        listing = spark.read.schema(LISTING_SCHEMA).parquet(path)
        levels.append(listing)
        frontier = listing.filter("kind = 'dir'").select("path")
        if frontier.isEmpty():
            break
    found = reduce(DataFrame.unionByName, levels)
    return Tree(found.filter("kind = 'file'").drop("kind"), found.filter("kind = 'unreadable'").select("path"))


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The files of ``scan_tree`` as (path, size, mtime, inside)."""
    return scan_tree(spark, root).files


def read_parts(manifest: DataFrame, root: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The bytes of every file as bounded parts, each read by itself with a seek.

    A file whose size or time no longer matches its manifest entry fails the read, so parts of
    two versions are never spliced; so does a file that resolves outside the root, or is gone.
    """
    found = _read(manifest, root, part_bytes, strict=True)
    return found.drop("gone")


def read_present_parts(manifest: DataFrame, root: str, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """``read_parts`` of the files that are still there, and the (path) of those that are gone.

    What was read is staged, so that both outputs come from one reading. A file of which some parts were read before it
    went fails, like a changed one.
    """
    path = scratch_path(manifest.sparkSession, "parts")
    read = _read(manifest, root, part_bytes, strict=False)
    read.write.parquet(path)
    staged = manifest.sparkSession.read.schema(read.schema).parquet(path)
    seen = staged.groupBy("path").agg(F.max("gone").alias("some"), F.min("gone").alias("all"))
    torn = seen.filter("some AND NOT all").select("path").first()
    if torn:
        raise RuntimeError(f"{torn['path']} was deleted after part of it had been packaged")
    return staged.filter("NOT gone").drop("gone"), seen.filter("all").select("path")


def _read(manifest: DataFrame, root: str, part_bytes: int, strict: bool) -> DataFrame:
    part_bytes = max(1, part_bytes)
    pieces = manifest.select("path", "size", "mtime", F.explode(part_offsets(F.col("size"), part_bytes)).alias("offset"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = os.path.realpath(root)
        for pdf in batches:
            # One part at a time: a whole batch of parts need not fit in memory.
            for piece in pdf.itertuples():
                if not _is_inside(base, os.path.realpath(os.path.join(root, piece.path))):
                    raise RuntimeError(f"{piece.path} resolves outside the root")
                payload, gone = b"", False
                try:
                    with open(os.path.join(root, piece.path), "rb") as handle:
                        facts = os.fstat(handle.fileno())
                        if (facts.st_size, int(facts.st_mtime)) != (piece.size, piece.mtime):
                            raise RuntimeError(f"{piece.path} changed while it was being packaged")
                        handle.seek(piece.offset)
                        payload = handle.read(part_bytes)
                except FileNotFoundError:
                    if strict:
                        raise
                    gone = True
                if not gone and not payload and piece.offset < piece.size:
                    raise RuntimeError(f"{piece.path} could not be read at {piece.offset}")
                end = piece.offset + len(payload)
                yield pd.DataFrame(
                    [(piece.path, piece.offset, len(payload), end >= piece.size, payload, gone)],
                    columns=["path", "offset", "length", "done", "payload", "gone"],
                )

    schema = "path string, offset bigint, length bigint, done boolean, payload binary, gone boolean"
    # Parts are of about one size, so a hash deals them evenly; the width follows from the bytes and is not merged away.
    total = manifest.agg(F.sum("size")).first()[0] or 0
    width = max(_slots(manifest.sparkSession), -(-total // TASK_BYTES))
    return pieces.repartition(width, "path", "offset").mapInPandas(read, schema)
