"""Segments: statement batches, build order, outline, pairing, file parts and reassembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions.literals import ROWS_PER_INSERT, quoted_name, row_tuple
from parcelry.operators.ordered import number_in_group
from parcelry.operators.slicing import Slices

PART_BYTES = 256 * 1024
CELL_BYTES = 1 << 30

# The order in which a selection's kinds are packaged.
KIND_ORDER = ["table", "structure", "file"]


def insert_batches(sliced: Slices, table: str, columns: Sequence[str]) -> DataFrame:
    """One extended statement per at most 100 rows of a slice."""
    return _statements(_rendered(sliced, columns), table)


def _rendered(sliced: Slices, columns: Sequence[str]) -> DataFrame:
    batch = F.floor((F.col("row_in_slice") - 1) / F.lit(ROWS_PER_INSERT)).cast("bigint")
    tuple_text = row_tuple(sliced.rows, columns)
    return sliced.rows.select("slice", "row_in_slice", batch.alias("batch"), tuple_text.alias("tuple"))


def _statements(rendered: DataFrame, table: str) -> DataFrame:
    joined = F.expr("listagg(tuple, ',') within group (order by row_in_slice)")
    statement = F.concat(F.lit(f"INSERT INTO {quoted_name(table)} VALUES "), F.col("tuples"), F.lit(";\n"))
    return (
        rendered.groupBy("slice", "batch")
        .agg(F.count("*").alias("rows"), joined.alias("tuples"))
        .select("slice", "batch", "rows", statement.alias("statement"))
    )


def table_segments(sliced: Slices, table: str, columns: Sequence[str], prefix: str) -> DataFrame:
    """One payload per slice, the first one headed by ``prefix``; includes the empty tail.

    Partitioning by slice once serves both groupings, so the rendered rows move only once.
    """
    statements = _statements(_rendered(sliced, columns).repartition("slice"), table)
    payload = F.expr("listagg(statement, '') within group (order by batch)")
    body = statements.groupBy("slice").agg(payload.alias("payload"))
    if sliced.needs_empty_tail:
        spark = body.sparkSession
        tail = spark.range(1).select(F.lit(sliced.count).cast("bigint").alias("slice"), F.lit("").alias("payload"))
        body = body.unionByName(tail)
    headed = F.when(F.col("slice") == 0, F.concat(F.lit(prefix), F.col("payload"))).otherwise(F.col("payload"))
    return body.select(F.col("slice").alias("part"), F.lit(table).alias("name"), headed.cast("binary").alias("payload"))


def segment_order(segments: DataFrame, group: Sequence[str] = ("job_id",)) -> DataFrame:
    """Adds the 0-based build position: tables, structures, files, each in list order, then parts."""
    rank = F.array_position(F.array(*[F.lit(kind) for kind in KIND_ORDER]), F.col("kind"))
    ranked = segments.withColumn("_rank", rank)
    placed = number_in_group(ranked, list(group), ["_rank", "ordinal", "part"], "seq")
    return placed.withColumn("seq", F.col("seq") - 1).drop("_rank")


def artifact_outline(segments: DataFrame) -> DataFrame:
    """Segment count, payload bytes and largest segment, per artifact and per name in it."""
    size = F.octet_length("payload").cast("bigint")
    by_name = segments.groupBy("artifact", "name").agg(
        F.count("*").alias("segments"), F.sum(size).alias("bytes"), F.max(size).alias("largest")
    )
    # The artifact rows are summed from the per-name rows, not from the segments again.
    levels = by_name.groupingSets([["artifact"], ["artifact", "name"]], "artifact", "name").agg(
        F.sum("segments").alias("segments"),
        F.sum("bytes").alias("bytes"),
        F.max("largest").alias("largest"),
        F.grouping("name").alias("_all_names"),
    )
    level = F.when(F.col("_all_names") == 1, "artifact").otherwise("name")
    return levels.select("artifact", level.alias("level"), "name", "segments", "bytes", "largest")


def pair_names(names: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs the nth name with the nth segment of an artifact; an unpaired side is an error row."""
    joined = names.select("artifact", "seq", "name").join(
        segments.select("artifact", "seq", "payload"), ["artifact", "seq"], "full_outer"
    )
    status = (
        F.when(F.col("name").isNull(), "no_name").when(F.col("payload").isNull(), "no_segment").otherwise("paired")
    )
    return joined.withColumn("status", status)


def reassemble(segments: DataFrame, group: Sequence[str] = ("name",), cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Concatenates payloads by name in ``seq`` order.

    A resource above ``cell_bytes`` does not fit one cell: it stays as its ordered rows,
    ``part`` giving the place of each, and the group is marked ``whole = false``. A ``length``
    column, when there is one, must hold the payload's size.
    """
    # A stored length spares the size check from reading the payloads.
    length = F.col("length") if "length" in segments.columns else F.octet_length("payload").cast("bigint")
    totals = segments.groupBy(*group).agg(F.sum(length).alias("bytes"))
    oversized = totals.filter(F.col("bytes") > cell_bytes).select(*group)
    if oversized.isEmpty():
        return _concatenated(segments, group)
    fits = segments.join(oversized, list(group), "left_anti")
    large = segments.join(oversized, list(group), "left_semi").select(
        *group, F.col("seq").cast("bigint").alias("part"), F.lit(False).alias("whole"), F.col("payload").cast("binary").alias("payload")
    )
    return _concatenated(fits, group).unionByName(large)


def _concatenated(segments: DataFrame, group: Sequence[str]) -> DataFrame:
    content = F.expr("listagg(cast(payload as binary)) within group (order by seq)")
    return (
        segments.groupBy(*group)
        .agg(content.alias("payload"))
        .select(*group, F.lit(0).cast("bigint").alias("part"), F.lit(True).alias("whole"), "payload")
    )


def part_offsets(size: Column, part_bytes: int = PART_BYTES) -> Column:
    """Offsets a file is cut at; an empty file still has its one empty part."""
    return F.sequence(F.lit(0).cast("bigint"), F.greatest(size - 1, F.lit(0)).cast("bigint"), F.lit(part_bytes).cast("bigint"))


def file_parts(df: DataFrame, part_bytes: int = PART_BYTES, content: str = "content", path: str = "path") -> DataFrame:
    """Cuts binary content into parts: offset, length, done and bytes.

    The cut happens inside an array before it is exploded, so the whole content is not
    copied once per part. The outer form keeps Spark from cutting everything a second time
    to test for emptiness; there is always at least one part.
    """
    part_bytes = max(1, part_bytes)
    body = F.col(content).cast("binary")
    size = F.octet_length(body).cast("bigint")

    def cut(offset: Column) -> Column:
        length = F.least(F.lit(part_bytes).cast("bigint"), size - offset)
        return F.struct(
            offset.alias("offset"),
            length.alias("length"),
            (offset + length >= size).alias("done"),
            F.substring(body, (offset + 1).cast("int"), length.cast("int")).alias("payload"),
        )

    pieces = F.transform(part_offsets(size, part_bytes), cut)
    return df.select(F.col(path).alias("path"), F.inline_outer(pieces))
