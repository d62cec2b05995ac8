"""Global row numbers without a single-task window.

The rows are range-partitioned and sorted by a total order, written once to the shared
folder with their (partition, position) id, and numbered by adding each partition's
prefix count. Writing once matters: range bounds are sampled afresh by every execution,
so a plan evaluated twice could split the rows at two different places.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.session import scratch_path

POSITION_BITS = 33  # layout of monotonically_increasing_id(): partition above, position below


class KeyNotUnique(ValueError):
    """A declared key has duplicates or nulls, so paging by it would lose rows."""


@dataclass(frozen=True)
class Staged:
    """Sorted rows on shared storage, with `part` and `pos` columns and the rows per part."""

    rows: DataFrame
    sizes: dict[int, int]

    @property
    def total(self) -> int:
        return sum(self.sizes.values())

    @property
    def rn(self) -> Column:
        """1-based global row number."""
        return prefix_lookup(self.sizes, F.col("part")) + F.col("pos") + 1


def prefix_lookup(sizes: dict[int, int], part: Column) -> Column:
    """Rows before each partition, as a constant array indexed by partition number.

    There is one entry per shuffle partition, so its size is set by the cluster's
    configuration and not by the data.
    """
    starts, before = [], 0
    for number in range(max(sizes, default=0) + 1):
        starts.append(str(before))
        before += sizes.get(number, 0)
    table = F.split(F.lit(",".join(starts)), ",").cast("array<bigint>")
    return F.element_at(table, (part + 1).cast("int"))


def stage_sorted(
    df: DataFrame,
    order: Sequence[str | Column],
    unique: Sequence[str] | None = None,
    derive: dict[str, Column] | None = None,
) -> Staged:
    """Write ``df`` sorted by ``order``; refuse when the ``unique`` key has nulls or repeats.

    ``derive`` adds columns after the exchange. The range exchange reads its input twice, once
    to sample the bounds, so costly expressions belong behind it.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order)
    bad: Column = F.lit(False)
    if unique:
        # The range exchange already clusters equal keys, so this window adds no shuffle.
        same_key = Window.partitionBy(*unique).orderBy(*unique)
        ranged = ranged.withColumn("_repeat", F.row_number().over(same_key) > 1)
        bad = F.col("_repeat")
        for name in unique:
            bad = bad | F.col(name).isNull()
    placed = (
        ranged.sortWithinPartitions(*order)
        .withColumn("_bad", bad)
        .withColumn("_id", F.monotonically_increasing_id())
        .drop("_repeat")
        .withColumns(derive or {})
    )
    path = scratch_path(spark, "sorted")
    placed.write.parquet(path)
    rows = (
        spark.read.schema(placed.schema)
        .parquet(path)
        .withColumn("part", F.shiftright("_id", POSITION_BITS))
        .withColumn("pos", F.col("_id").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))
    )
    stats = rows.groupBy("part").agg(F.count("*").alias("n"), F.max("_bad").alias("bad")).collect()
    if any(row["bad"] for row in stats):
        raise KeyNotUnique(f"key {list(unique or [])} has duplicate or null values")
    return Staged(rows.drop("_id", "_bad"), {row["part"]: row["n"] for row in stats})


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    unique: Sequence[str] | None = None,
    name: str = "rn",
    derive: dict[str, Column] | None = None,
) -> tuple[DataFrame, int]:
    """``df`` plus a 1-based row number along ``order``, and the row count."""
    staged = stage_sorted(df, order, unique, derive)
    return staged.rows.withColumn(name, staged.rn).drop("part", "pos"), staged.total


def number_keyed(
    df: DataFrame, key: Sequence[str], name: str = "rn", derive: dict[str, Column] | None = None
) -> tuple[DataFrame, int]:
    """Numbers along a declared key, which must be unique and never null."""
    return number_rows(df, list(key), unique=list(key), name=name, derive=derive)


def with_file_order(df: DataFrame) -> DataFrame:
    """Adds the stored position of every row: the order of a table that has no key."""
    return df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))


FILE_BROADCAST_ROWS = 100_000


def number_stored(df: DataFrame, name: str = "rn") -> tuple[DataFrame, int]:
    """Numbers a keyless table in stored order: rows per file, then the place in the file.

    Nothing is sorted and no row is shuffled. Valid while the files do not change, which is
    what an unordered walk by offset assumes too. ``df`` must be a plain file read.
    """
    columns = df.columns
    placed = with_file_order(df)
    files = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    one_row_per_file = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(
        "_file", "_n", F.coalesce(F.sum("_n").over(one_row_per_file), F.lit(0)).alias("_before")
    )
    size = starts.agg(F.count("*").alias("files"), F.sum("_n").alias("rows")).first()
    lookup = starts.drop("_n")
    if size["files"] <= FILE_BROADCAST_ROWS:
        lookup = F.broadcast(lookup)
    numbered = placed.join(lookup, "_file").withColumn(name, F.col("_before") + F.col("_row") + 1)
    return numbered.select(*columns, name), size["rows"] or 0
