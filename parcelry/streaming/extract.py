"""Resumable extraction: micro-batches continue one slice walk.

The last slice of a batch may not be full, so its rows stay open: they are carried to the next batch in the ledger beside
the segments, with the number of parts written and the last key seen, and the walk goes on from there. Segments are
those of the whole table cut at once, however its rows are dealt over files and batches. The checkpoint remembers which
files are done; a batch cut short leaves nothing that counts: after a restart it runs again over the same files and
the same carried rows and replaces its own output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parcelry.operators.segments import table_segments
from parcelry.operators.slicing import SLICE_BYTES, SLICE_ROWS, slice_table
from parcelry.session import scratch_scope
from parcelry.sources.tables import data_header, structure_text
from parcelry.streaming.ledger import Ledger
from parcelry.streaming.run import start_batches, write_batch

PARTS = T.StructType([T.StructField("parts", T.LongType())])


def _offset(ledger: Ledger, batch_id: int) -> int:
    row = ledger.read("parts", batch_id, PARTS).first()
    return row["parts"] if row else 0


def _written(rows: DataFrame, table: str, key: Sequence[str], offset: int, max_rows: int, max_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """Segments of ``rows`` with parts from ``offset`` on, the rows by slice, and the number of the last slice that has rows."""
    columns = rows.columns
    prefix = structure_text(table, rows.schema) + data_header(table)
    sliced = slice_table(rows, key, max_rows, max_bytes)
    last = sliced.rows.agg(F.max("slice")).first()[0]
    segments = table_segments(sliced, table, columns, "" if offset else prefix)
    return segments.withColumn("part", F.col("part") + offset), sliced.rows.select("slice", *columns), -1 if last is None else last


def extract_stream(
    stream: DataFrame,
    table: str,
    key: Sequence[str],
    path: str,
    checkpoint: str,
    max_rows: int = SLICE_ROWS,
    max_bytes: int = SLICE_BYTES,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Writes ``(part, name, payload)`` of every full slice under one ``batch=`` folder per micro-batch.

    Keys must ascend from batch to batch, which also makes them unique over all of them; a batch that goes back is refused.
    ``finish_extract`` writes what is open once the stream has ended.
    """
    schema = stream.schema

    def package(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ledger = Ledger(spark, path)
        place = F.struct(*key)
        with scratch_scope(spark):
            held, offset = ledger.read("open", batch_id - 1, schema), _offset(ledger, batch_id - 1)
            last, first = held.agg(F.max(place).alias("k")), batch.agg(F.min(place).alias("f"))
            back = first.crossJoin(last).filter("f <= k").first()  # one row each
            if back:
                raise ValueError(f"batch {batch_id} begins at {back['f']}, not behind {back['k']}")
            segments, rows, last = _written(batch.unionByName(held), table, key, offset, max_rows, max_bytes)
            write_batch(segments.filter(F.col("part") < offset + last), path, batch_id)
            ledger.write(rows.filter(F.col("slice") == last).drop("slice"), "open", batch_id)
            ledger.write(spark.range(1).select(F.lit(offset + max(last, 0)).cast("long").alias("parts")), "parts", batch_id)

    return start_batches(stream, package, checkpoint, trigger=trigger)


def finish_extract(
    spark: SparkSession, schema: T.StructType, table: str, key: Sequence[str], path: str, max_rows: int = SLICE_ROWS, max_bytes: int = SLICE_BYTES
) -> None:
    """Writes the open slice as the last part. A stream that goes on later replaces it by its next batch."""
    ledger = Ledger(spark, path)
    last = ledger.last("parts")
    with scratch_scope(spark):
        segments, _, _ = _written(ledger.read("open", last, schema), table, key, _offset(ledger, last), max_rows, max_bytes)
        write_batch(segments, path, last + 1)


def read_extracted(spark: SparkSession, path: str) -> DataFrame:
    """Segments in arrival order: by batch, then by part."""
    schema = "part bigint, name string, payload binary, batch bigint"
    return spark.read.schema(schema).option("basePath", path).parquet(path)
