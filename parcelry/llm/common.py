"""What the operators share: staged tables, checked broadcasts, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.session import scratch_path, scratch_scope

#: ``[^\x20\x09-\x0D]+`` are words; everything else here is white space between them.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Rows of a table that may be broadcast; narrow rows only, so some tens of megabytes.
BROADCAST_ROWS = 500_000


def stage(frame: DataFrame, label: str) -> DataFrame:
    """Writes ``frame`` to the shared folder and returns it as read from there: its lineage ends, and it survives lost executors."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``stage`` of what ``make`` returns, after which every table staged while making it is dropped."""
    path = scratch_path(spark, label)
    with scratch_scope(spark):
        frame = make()
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a narrow table for broadcast if a count proves it has at most ``rows`` rows; else leaves the join to shuffle."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose ``key`` is in the only column of ``ids``; null keys stay. No column is added."""
    gone = small(stage(ids.toDF("_gone").distinct(), "gone"))
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")


def chosen(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in the only column of ``ids``."""
    held = small(ids.toDF("_held").distinct())
    return docs.join(held, docs[key] == held["_held"], "left_semi")


def map_batches(frame: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` over every Arrow batch; batches without rows are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                if made is not None and made.num_rows:
                    yield made

    return frame.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def plain(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so extra columns neither clash nor travel."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
