"""Segment tables on shared storage, published whole.

Rows go to a folder of their own below ``_data``, which no reader looks into, until one small file, ``_published``, names that
folder. The file is created only where there is none, so of two writers one wins, and its last line tells a reader that it
is all there.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SEGMENT_SCHEMA = "artifact string, seq bigint, name string, payload binary"
COLUMNS = ["artifact", "seq", "name", "payload"]
END = "published"


class NotPublished(FileNotFoundError):
    """There is no such artifact, or its writer has not ended."""


def _commit_file(spark: SparkSession, path: str):
    commit = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_published")
    return commit, commit.getFileSystem(spark._jsc.hadoopConfiguration())


def write_segments(segments: DataFrame, path: str) -> None:
    """Publishes segments as one table, whole or not at all; a path that holds one is refused.

    What a failed write left is never read, and a later write to the same path may succeed.
    """
    spark = segments.sparkSession
    commit, files = _commit_file(spark, path)
    if files.exists(commit):
        raise FileExistsError(f"{path} already exists")
    folder = uuid.uuid4().hex
    segments.select(*COLUMNS).write.parquet(f"{path.rstrip('/')}/_data/{folder}")
    try:
        out = files.create(commit, False)
    except Py4JJavaError as lost:
        if files.exists(commit):
            raise FileExistsError(f"{path} already exists") from lost
        raise
    out.write(bytearray(f"{folder}\n{END}\n".encode()))
    out.close()


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A published table; ``NotPublished`` before its writer has ended."""
    commit, files = _commit_file(spark, path)
    lines = []
    if files.exists(commit):
        stream = files.open(commit)  # two short lines
        lines = bytes(iter(stream.read, -1)).decode().splitlines()
        stream.close()
    if lines[1:] != [END]:
        raise NotPublished(f"{path} is not published")
    return spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path.rstrip('/')}/_data/{lines[0]}")
