"""Slices bounded by rows and by rendered bytes.

A slice ends at the row that fills the byte budget (that row included) or at the row
limit, and the next slice starts right after it. Where each slice starts therefore
depends on every slice before it.

Most tables never reach the byte budget inside a full row page. One map-side aggregate
proves that, and then the slice number is plain division. Otherwise the rows are cut
into blocks; each block works out, for every row a slice could first start on, where the
slices leave the block again. Those little tables compose associatively, so the blocks
are chained group by group, then across groups, and each block is replayed from the one
entry that really occurs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions.literals import ROWS_PER_INSERT, row_size
from parcelry.operators.numbering import number_keyed, number_rows
from parcelry.session import scratch_path

SLICE_ROWS = 1000
SLICE_BYTES = 4 * 1024 * 1024
DRIVER_CELLS = 4_000_000


def effective_limit(max_rows: int) -> int:
    """The row limit, rounded down to whole statements once it holds at least one."""
    if max_rows >= ROWS_PER_INSERT:
        return max_rows - max_rows % ROWS_PER_INSERT
    return max(1, max_rows)


@dataclass(frozen=True)
class Slices:
    """Rows with ``slice`` (0-based) and ``row_in_slice`` (1-based), and what the walk ended on."""

    rows: DataFrame
    count: int
    last_rows: int
    limit: int

    @property
    def needs_empty_tail(self) -> bool:
        """A full last slice does not prove the end, so one empty slice follows it."""
        return self.count == 0 or self.last_rows == self.limit


def slice_table(
    df: DataFrame,
    key: Sequence[str] | None,
    max_rows: int = SLICE_ROWS,
    max_bytes: int = SLICE_BYTES,
    order: Sequence[str | Column] | None = None,
    size: Column | None = None,
    block_rows: int | None = None,
    keep: Sequence[str] | None = None,
) -> Slices:
    """Slice ``df`` along its key, or along an explicit total order when it has none.

    ``keep`` names the columns wanted on the sliced rows, all of them by default. With the
    key alone, the wide rows are read once to measure them and never shuffled.
    """
    if not key and not order:
        raise ValueError("a table without a key needs an explicit order")
    size = (row_size(df) + 1 if size is None else size).cast("bigint")
    derive = {"row_bytes": size}
    if keep is not None:
        df, derive = _measured(df, keep, size), {}
    if key:
        numbered, total = number_keyed(df, key, derive=derive)
    else:
        numbered, total = number_rows(df, order, derive=derive)
    return cut_slices(numbered, total, max_rows, max_bytes, block_rows)


def _measured(df: DataFrame, keep: Sequence[str], size: Column) -> DataFrame:
    """The kept columns and each row's rendered size, written out so rendering happens once."""
    spark = df.sparkSession
    narrow = df.select(*keep, size.alias("row_bytes"))
    path = scratch_path(spark, "measured")
    narrow.write.parquet(path)
    return spark.read.schema(narrow.schema).parquet(path)


def cut_slices(
    numbered: DataFrame, total: int, max_rows: int, max_bytes: int, block_rows: int | None = None
) -> Slices:
    """Slice rows that already carry ``rn`` and ``row_bytes``."""
    limit, budget = effective_limit(max_rows), max(1, max_bytes)
    zero_based = F.col("rn") - 1
    by_rows = F.floor(zero_based / F.lit(limit)).cast("bigint")
    if total == 0 or not _budget_binds(numbered, by_rows, limit, budget):
        rows = numbered.withColumn("slice", by_rows).withColumn(
            "row_in_slice", (zero_based % F.lit(limit) + 1).cast("bigint")
        )
        count = -(-total // limit)
        return Slices(rows, count, total - (count - 1) * limit if count else 0, limit)
    return _cut_by_blocks(numbered, total, limit, budget, block_rows)


def _budget_binds(numbered: DataFrame, by_rows: Column, limit: int, budget: int) -> bool:
    """Whether any row page fills the byte budget before its last row."""
    inner = F.when((F.col("rn") - 1) % F.lit(limit) < limit - 1, F.col("row_bytes")).otherwise(F.lit(0))
    filled = numbered.groupBy(by_rows.alias("page")).agg(F.sum(inner).alias("bytes")).filter(F.col("bytes") >= budget)
    return not filled.isEmpty()


def _next_start(sizes: np.ndarray, own: int, limit: int, budget: int) -> np.ndarray:
    """For each own row, the row after the slice that would start on it."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    start = np.arange(own)
    by_bytes = np.searchsorted(ends, ends[:own] + budget, side="left")
    return np.minimum(np.minimum(by_bytes, start + limit), len(sizes))


def _block_exits(sizes: np.ndarray, own: int, limit: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Exit offset into the next block, and slices started here, per possible entry offset."""
    jump = _next_start(sizes, own, limit, budget)
    steps = np.ones(own, dtype=np.int64)
    inside = jump < own
    while inside.any():
        target = jump[inside]
        steps[inside] += steps[target]
        jump[inside] = jump[target]
        inside = jump < own
    entries = np.arange(limit)
    exits, counts = entries - own, np.zeros(limit, dtype=np.int64)
    reach = min(limit, own)
    exits[:reach] = jump[:reach] - own
    counts[:reach] = steps[:reach]
    return np.maximum(exits, 0).astype("<i4"), counts.astype("<i8")


def _chain(tables: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    exits = counts = None
    for row in tables.itertuples():
        step_exits, step_counts = np.frombuffer(row.exits, "<i4"), np.frombuffer(row.counts, "<i8")
        if exits is None:
            exits, counts = step_exits, step_counts
        else:
            counts = counts + step_counts[exits]
            exits = step_exits[exits]
    return exits, counts


def _cut_by_blocks(numbered: DataFrame, total: int, limit: int, budget: int, block_rows: int | None) -> Slices:
    spark = numbered.sparkSession
    width = max(limit, block_rows or max(128 * limit, 1 << 18))
    blocks = -(-total // width)
    groups = max(1, min(blocks, DRIVER_CELLS // limit, 4096))
    group_blocks = -(-blocks // groups)

    # Every block also sees the first rows of the next one: a slice may run over its end.
    zero_based = F.col("rn") - 1
    own = F.floor(zero_based / F.lit(width)).cast("bigint")
    seen_by = F.when((zero_based % width < limit - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    sizes = numbered.select("rn", "row_bytes", F.explode(seen_by).alias("block"))

    def exits_of(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        own_rows = min(width, total - block * width)
        lengths = pdf.sort_values("rn")["row_bytes"].to_numpy(dtype=np.int64)
        exits, counts = _block_exits(lengths, own_rows, limit, budget)
        return pd.DataFrame(
            {
                "block": [block],
                "block_group": [block // group_blocks],
                "sizes": [lengths.astype("<i4").tobytes()],
                "exits": [exits.tobytes()],
                "counts": [counts.tobytes()],
            }
        )

    path = scratch_path(spark, "slice-blocks")
    block_schema = "block bigint, block_group bigint, sizes binary, exits binary, counts binary"
    sizes.groupBy("block").applyInPandas(exits_of, block_schema).write.parquet(path)
    table = spark.read.schema(block_schema).parquet(path)

    # Chain the blocks of each group; the driver chains the groups, a bounded number of tables.
    def chain_group(pdf: pd.DataFrame) -> pd.DataFrame:
        exits, counts = _chain(pdf.sort_values("block"))
        return pd.DataFrame(
            {"block_group": [pdf["block_group"].iloc[0]], "exits": [exits.tobytes()], "counts": [counts.tobytes()]}
        )

    chained = (
        table.select("block", "block_group", "exits", "counts")
        .groupBy("block_group")
        .applyInPandas(chain_group, "block_group bigint, exits binary, counts binary")
        .orderBy("block_group")
        .collect()
    )
    entry, started, starts = 0, 0, {}
    for row in chained:
        starts[row["block_group"]] = (entry, started)
        started += int(np.frombuffer(row["counts"], "<i8")[entry])
        entry = int(np.frombuffer(row["exits"], "<i4")[entry])

    def replay_group(pdf: pd.DataFrame) -> pd.DataFrame:
        at, number = starts[int(pdf["block_group"].iloc[0])]
        out = []
        for row in pdf.sort_values("block").itertuples():
            out.append((row.block, at, number))
            number += int(np.frombuffer(row.counts, "<i8")[at])
            at = int(np.frombuffer(row.exits, "<i4")[at])
        return pd.DataFrame(out, columns=["block", "entry", "first_slice"])

    entries = (
        table.select("block", "block_group", "exits", "counts")
        .groupBy("block_group")
        .applyInPandas(replay_group, "block bigint, entry bigint, first_slice bigint")
    )

    def replay_block(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        own_rows = min(width, total - int(row["block"]) * width)
        lengths = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        jump = _next_start(lengths, own_rows, limit, budget)
        begins, at = [], int(row["entry"])
        while at < own_rows:
            begins.append(at)
            at = int(jump[at])
        begin = np.array(begins, dtype=np.int64)
        return pd.DataFrame(
            {
                "slice": int(row["first_slice"]) + np.arange(len(begin)),
                "first_rn": int(row["block"]) * width + begin + 1,
                "last_rn": int(row["block"]) * width + jump[begin],
            }
        )

    cuts_path = scratch_path(spark, "slice-cuts")
    cuts_schema = "slice bigint, first_rn bigint, last_rn bigint"
    # Grouped by block, which the join already partitions by, so a task holds one block at a time.
    placed = table.select("block", "sizes").join(entries, "block")
    placed.groupBy("block").applyInPandas(replay_block, cuts_schema).write.parquet(cuts_path)
    cuts = spark.read.schema(cuts_schema).parquet(cuts_path)
    last = cuts.filter(F.col("last_rn") == total).select((F.col("last_rn") - F.col("first_rn") + 1).alias("n")).first()
    return Slices(_place_rows(numbered, cuts, total, started), started, last["n"], limit)


def _place_rows(numbered: DataFrame, cuts: DataFrame, total: int, count: int) -> DataFrame:
    """Gives each row its slice by an equi-join on windows of row numbers.

    With windows as long as the mean slice, rows meet about two slices each over the
    whole table, however uneven the slices are.
    """
    width = max(1, total // max(1, count))
    window_of = lambda rn: F.floor((rn - 1) / F.lit(width)).cast("bigint")
    spread = cuts.withColumn("_window", F.explode(F.sequence(window_of(F.col("first_rn")), window_of(F.col("last_rn")))))
    rows = numbered.withColumn("_window", window_of(F.col("rn")))
    inside = (F.col("rn") >= F.col("first_rn")) & (F.col("rn") <= F.col("last_rn"))
    return (
        rows.join(spread, "_window")
        .filter(inside)
        .withColumn("row_in_slice", F.col("rn") - F.col("first_rn") + 1)
        .drop("_window", "first_rn", "last_rn")
    )


def slice_summary(sliced: Slices, key: Sequence[str] = ()) -> DataFrame:
    """One row per slice: rows, rendered bytes, first and last key, and whether the table ends there."""
    spark = sliced.rows.sparkSession
    firsts = [F.min_by(name, "rn").alias(f"first_{name}") for name in key]
    lasts = [F.max_by(name, "rn").alias(f"last_{name}") for name in key]
    full = sliced.rows.groupBy("slice").agg(F.count("*").alias("rows"), F.sum("row_bytes").alias("bytes"), *firsts, *lasts)
    final = sliced.count if sliced.needs_empty_tail else sliced.count - 1
    if sliced.needs_empty_tail:
        tail = spark.range(1).select(
            F.lit(sliced.count).cast("bigint").alias("slice"),
            F.lit(0).cast("bigint").alias("rows"),
            F.lit(0).cast("bigint").alias("bytes"),
            *[F.lit(None).cast(full.schema[f"first_{name}"].dataType).alias(f"first_{name}") for name in key],
            *[F.lit(None).cast(full.schema[f"last_{name}"].dataType).alias(f"last_{name}") for name in key],
        )
        full = full.unionByName(tail)
    return full.withColumn("complete", F.col("slice") == final)
