"""Ordered work inside groups that stays parallel when one group holds most of the rows.

A window partitioned by a group sends the whole group to one task. That is right for
ordinary groups and fatal for a hot one, so groups above ``HOT_ROWS`` take another way:
their rows are range-split by (group, order), each piece is windowed by itself, and the
state at the piece's start is carried in from the pieces before it. Both ways give the
same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelry.operators.numbering import stage_sorted

HOT_ROWS = 2_000_000


@dataclass(frozen=True)
class HotGroups:
    """Groups above the limit. There are at most (rows / limit), which bounds collect and broadcast."""

    found: list[Row]
    schema: T.StructType


def find_hot(df: DataFrame, group: Sequence[str], hot_rows: int = HOT_ROWS) -> HotGroups:
    """Counts groups map-side. The result also serves any frame with no more rows per group."""
    hot = df.groupBy(*group).count().filter(F.col("count") > hot_rows).drop("count")
    return HotGroups(hot.collect(), hot.schema)


def _by_heat(
    df: DataFrame,
    group: Sequence[str],
    heat: int | HotGroups,
    usual: Callable[[DataFrame], DataFrame],
    split: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    if not group:
        return split(df)
    hot = heat if isinstance(heat, HotGroups) else find_hot(df, group, heat)
    if not hot.found:
        return usual(df)
    listed = F.broadcast(df.sparkSession.createDataFrame(hot.found, hot.schema))
    condition = F.lit(True)
    for name in group:
        condition = condition & df[name].eqNullSafe(listed[name])
    cold_rows = df.join(listed, condition, "left_anti")
    hot_rows = df.join(listed, condition, "left_semi")
    return usual(cold_rows).unionByName(split(hot_rows))


def _with_carry(rows: DataFrame, group: Sequence[str], carry: DataFrame) -> DataFrame:
    """Joins the one carried-in value per (piece, group) back to its rows.

    Carries exist only where a group continues from an earlier piece; a piece has at most
    one such group, so the table never has more rows than there are pieces.
    """
    condition = rows["part"] == carry["_part"]
    for name in group:
        condition = condition & rows[name].eqNullSafe(carry[f"_g_{name}"])
    return rows.join(F.broadcast(carry), condition, "left").drop("_part", *[f"_g_{name}" for name in group])


def _carry(staged_rows: DataFrame, group: Sequence[str], summary: Column, carried: Callable[[Window], Column]) -> DataFrame:
    pieces = staged_rows.groupBy("part", *group).agg(summary.alias("_piece"))
    along = Window.partitionBy(*group).orderBy("part") if group else Window.partitionBy(F.lit(0)).orderBy("part")
    first = F.row_number().over(along) == 1
    named = [F.col(name).alias(f"_g_{name}") for name in group]
    return (
        pieces.withColumn("_carried", carried(along))
        .withColumn("_first", first)
        .filter(~F.col("_first"))
        .select(F.col("part").alias("_part"), *named, "_carried")
    )


def number_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str, heat: int | HotGroups = HOT_ROWS
) -> DataFrame:
    """1-based position of every row in its group."""

    def usual(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))

    def split(rows: DataFrame) -> DataFrame:
        staged = stage_sorted(rows, [*group, *order])
        numbered = staged.rows.withColumn(name, staged.rn).drop("part", "pos")
        if not group:
            return numbered
        starts = numbered.groupBy(*group).agg(F.min(name).alias("_start"))
        starts = starts.select(*[F.col(c).alias(f"_g_{c}") for c in group], "_start")
        condition = F.lit(True)
        for column in group:
            condition = condition & numbered[column].eqNullSafe(starts[f"_g_{column}"])
        joined = numbered.join(F.broadcast(starts), condition)  # one row per hot group
        return joined.withColumn(name, F.col(name) - F.col("_start") + 1).select(*df.columns, name)

    return _by_heat(df, group, heat, usual, split)


def running_sum_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, Column],
    heat: int | HotGroups = HOT_ROWS,
) -> DataFrame:
    """Adds running totals, current row included, of integer expressions along the order."""

    def usual(rows: DataFrame) -> DataFrame:
        so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select("*", *[F.sum(expr).over(so_far).alias(name) for name, expr in sums.items()])

    def split(rows: DataFrame) -> DataFrame:
        prepared = rows.select("*", *[expr.alias(f"_v_{name}") for name, expr in sums.items()])
        staged = stage_sorted(prepared, [*group, *order])
        so_far = Window.partitionBy("part", *group).orderBy("pos").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        within = staged.rows.select("*", *[F.sum(f"_v_{name}").over(so_far).alias(f"_w_{name}") for name in sums])
        totals = F.struct(*[F.sum(f"_v_{name}").alias(name) for name in sums])

        def before(along: Window) -> Column:
            earlier = along.rowsBetween(Window.unboundedPreceding, -1)
            return F.struct(*[F.sum(F.col(f"_piece.{name}")).over(earlier).alias(name) for name in sums])

        carry = _carry(staged.rows, group, totals, before)
        joined = _with_carry(within, group, carry)
        outputs = [
            (F.col(f"_w_{name}") + F.coalesce(F.col(f"_carried.{name}"), F.lit(0))).alias(name) for name in sums
        ]
        return joined.select(*df.columns, *outputs)

    return _by_heat(df, group, heat, usual, split)


def previous_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    columns: dict[str, str],
    heat: int | HotGroups = HOT_ROWS,
) -> DataFrame:
    """Adds the previous row's values (``new name -> column``); reverse the order to look ahead."""
    packed = F.struct(*[F.col(source).alias(target) for target, source in columns.items()])

    def usual(rows: DataFrame) -> DataFrame:
        along = Window.partitionBy(*group).orderBy(*order)
        return rows.select("*", *[F.lag(source).over(along).alias(target) for target, source in columns.items()])

    def split(rows: DataFrame) -> DataFrame:
        staged = stage_sorted(rows, [*group, *order])
        along = Window.partitionBy("part", *group).orderBy("pos")
        within = staged.rows.withColumn("_prev", F.lag(packed).over(along))
        last = F.max_by(packed, F.col("pos"))
        carry = _carry(staged.rows, group, last, lambda pieces: F.lag("_piece").over(pieces))
        joined = _with_carry(within, group, carry)
        outputs = [
            F.when(F.col("_prev").isNotNull(), F.col(f"_prev.{target}"))
            .otherwise(F.col(f"_carried.{target}"))
            .alias(target)
            for target in columns
        ]
        return joined.select(*df.columns, *outputs)

    return _by_heat(df, group, heat, usual, split)
