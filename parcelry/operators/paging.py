"""Keyset pages, offset pages and newest-first pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions.scalars import iso_utc
from parcelry.operators.numbering import number_keyed, number_rows, with_file_order

TOP_K_ROWS = 10_000


def after_key(key: Sequence[str], cursor: Sequence[object]) -> Column:
    """Rows strictly after ``cursor`` in key order.

    Spelled out column by column, with the bound on the leading column repeated in front,
    because that is the form the Parquet scan can prune by.
    """
    if len(key) != len(cursor):
        raise ValueError("the cursor does not have one value per key column")
    branches = []
    for depth, (name, value) in enumerate(zip(key, cursor, strict=True)):
        pinned = [F.col(k) == F.lit(v) for k, v in zip(key[:depth], cursor[:depth], strict=True)]
        branches.append(reduce(lambda a, b: a & b, [*pinned, F.col(name) > F.lit(value)]))
    return (F.col(key[0]) >= F.lit(cursor[0])) & reduce(lambda a, b: a | b, branches)


def page_after(df: DataFrame, key: Sequence[str], cursor: Sequence[object] | None, n: int) -> DataFrame:
    """The next ``n`` rows in key order: a filter and a top-k."""
    rows = df if cursor is None else df.filter(after_key(key, cursor))
    return rows.orderBy(*key).limit(max(1, n))


def page_offset(df: DataFrame, skip: int, n: int) -> DataFrame:
    """``n`` rows of a keyless table after ``skip`` rows, in stored order.

    Row counts per file place the window, so only the files it touches are read.
    """
    files = with_file_order(df).groupBy("_file").agg(F.count("*").alias("n")).orderBy("_file")
    wanted, before = [], 0
    for row in files.toLocalIterator():
        if before >= skip + n:
            break
        if before + row["n"] > skip:
            wanted.append((row["_file"], max(0, skip - before), min(row["n"], skip + n - before)))
        before += row["n"]
    inside = F.lit(False)
    for path, low, high in wanted:
        inside = inside | ((F.col("_file") == path) & (F.col("_row") >= low) & (F.col("_row") < high))
    # The bare file condition prunes the listing; the row condition works inside the files.
    touched = df.filter(F.col("_metadata.file_path").isin([path for path, *_ in wanted]))
    return with_file_order(touched).filter(inside).select(*df.columns)


def page_offset_by(df: DataFrame, order: Sequence[str | Column], skip: int, n: int) -> DataFrame:
    """``n`` rows after ``skip`` along an explicit order; far pages go through row numbers."""
    if skip + n <= TOP_K_ROWS:
        return df.orderBy(*order).offset(skip).limit(n)
    rows, _ = number_rows(df, order)
    return rows.filter((F.col("rn") > skip) & (F.col("rn") <= skip + n)).drop("rn")


def keyset_pages(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """Every page of a keyset walk: rows, first key, and the cursor (last key) it ends on."""
    rows, total = number_keyed(df.select(*key), key)
    # Only the rows at page ends are grouped; the numbers already tell how many lie between.
    place = (F.col("rn") - 1) % F.lit(n)
    opens, closes = place == 0, (place == n - 1) | (F.col("rn") == total)
    page = F.floor((F.col("rn") - 1) / F.lit(n)).cast("bigint")
    firsts = [F.max(F.when(opens, F.col(name))).alias(f"first_{name}") for name in key]
    lasts = [F.max(F.when(closes, F.col(name))).alias(f"last_{name}") for name in key]
    ends = rows.filter(opens | closes).groupBy(page.alias("page"))
    rows_in = (F.max("rn") - F.min("rn") + 1).alias("rows")
    return ends.agg(rows_in, *firsts, *lasts)


def audit_page(
    entries: DataFrame,
    page: int = 1,
    per_page: int = 50,
    date_from: str | None = None,
    date_to: str | None = None,
    max_per_page: int | None = None,
) -> DataFrame:
    """One newest-first page of audit entries with the total; ties keep append order. ``max_per_page`` is a limit of the caller's.

    ``entries`` carries ``ts`` (Unix seconds) and ``seq``. Counts per day choose the days
    the page lies in, so a far page does not sort the log.
    """
    page, per_page = max(1, page), max(1, per_page)
    per_page = per_page if max_per_page is None else min(max_per_page, per_page)
    rows = day_window(entries, date_from, date_to)
    day = F.floor(F.col("ts") / 86400).cast("bigint")
    days = rows.groupBy(day.alias("day")).count().orderBy(F.desc("day")).collect()
    total = sum(row["count"] for row in days)
    skip, before, chosen, inner_skip = (page - 1) * per_page, 0, [], 0
    for row in days:
        if before < skip + per_page and before + row["count"] > skip:
            if not chosen:
                inner_skip = skip - before
            chosen.append(row["day"])
        before += row["count"]
    if not chosen:
        picked = rows.filter(F.lit(False))
    else:
        near = rows.filter((F.col("ts") >= chosen[-1] * 86400) & (F.col("ts") < (chosen[0] + 1) * 86400))
        picked = page_offset_by(near, [F.desc("ts"), F.asc("seq")], inner_skip, per_page)
    return picked.withColumn("ts", iso_utc(F.col("ts"))).withColumn("total", F.lit(total).cast("bigint"))


def audit_listing(entries: DataFrame, page: int = 1, per_page: int = 50, **limits: object) -> DataFrame:
    """One row: the page's ``entries`` in order, and ``total``, ``page`` and ``per_page`` even where the page is empty."""
    rows = audit_page(entries, page, per_page, **limits).drop("total")
    size = max(1, per_page) if limits.get("max_per_page") is None else min(limits["max_per_page"], max(1, per_page))
    newest = lambda a, b: F.when(a["ts"] != b["ts"], F.when(a["ts"] > b["ts"], -1).otherwise(1)).otherwise((a["seq"] - b["seq"]).cast("int"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns)), newest).alias("entries"))
    total = day_window(entries, limits.get("date_from"), limits.get("date_to")).count()
    numbers = {"total": total, "page": max(1, page), "per_page": size}
    return listed.select("entries", *[F.lit(value).cast("bigint").alias(name) for name, value in numbers.items()])


def parse_day(text: str | None) -> int | None:
    """Unix second a UTC day starts on; an unreadable date is an error rather than an open bound."""
    if not text:
        return None
    parsed = dt.datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=dt.timezone.utc)
    return int(parsed.timestamp())


def day_window(df: DataFrame, date_from: str | None, date_to: str | None, ts: str = "ts") -> DataFrame:
    """Rows with an integer timestamp inside the inclusive UTC days; a missing bound is open."""
    low, high = parse_day(date_from), parse_day(date_to)
    keep = F.col(ts).isNotNull()
    if low is not None:
        keep = keep & (F.col(ts) >= F.lit(low))
    if high is not None:
        keep = keep & (F.col(ts) < F.lit(high + 86400))
    if "day" in df.columns:
        # The log is partitioned by day; repeating the bounds on it prunes the folders.
        if low is not None:
            keep = keep & (F.col("day") >= F.lit(date_from).cast("date"))
        if high is not None:
            keep = keep & (F.col("day") <= F.lit(date_to).cast("date"))
    return df.filter(keep)
