"""Checking a selection: missing names, file classes, overlaps, and one verdict per request.

A selection has rows ``(job_id, kind, ordinal, name)`` with kind ``table``, ``structure`` or
``file``. Catalogue and manifest joins go by name; a name asked for by very many requests is
left to AQE's skew-join split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions.paths import is_hostile, is_restricted, resolved, scattered

SELECTION_CAP = 500_000
#: Entries that one task of a verdict holds, on average, and those below which another task is not worth its start.
ENTRIES_PER_TASK, FEWEST_PER_TASK = 500_000, 50_000
#: Tasks over which one request's entries are spread.
SHARES = 16
TABLE_KINDS = ["table", "structure"]


def missing_tables(selection: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every requested table name the catalogue lacks, with its place in the request."""
    tables = selection.filter(F.col("kind").isin(TABLE_KINDS))
    return tables.join(catalog.select("name"), "name", "left_anti").select("job_id", "kind", "ordinal", "name")


def classify_files(selection: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each requested file is kept, vanished, or out of bounds; hostility is judged first.

    Where the manifest tells (``inside``), a link whose target lies outside the root is out of bounds.
    """
    files = selection.filter(F.col("kind") == "file").withColumn("_hostile", is_hostile(F.col("name")))
    path = F.when(~F.col("_hostile"), resolved(F.col("name")))
    files = files.withColumn("_path", scattered(path, "job_id", "ordinal"))
    known = _known_paths(manifest, "_known")
    label = F.when(F.col("_hostile") | ~F.col("_known"), "out_of_bounds").when(F.col("_known"), "kept").otherwise("vanished")
    joined = files.join(known, "_path", "left")
    return joined.select("job_id", "ordinal", "name", label.alias("class"))


def _known_paths(manifest: DataFrame, flag: str) -> DataFrame:
    """(_path, flag) per path of the manifest; the flag is false where the path resolves outside the root."""
    inside = F.col("inside") if "inside" in manifest.columns else F.lit(True)
    return manifest.select(F.col("path").alias("_path"), inside.alias("_inside")).groupBy("_path").agg(F.min("_inside").alias(flag))


def selection_overlap(selection: DataFrame) -> DataFrame:
    """Names a request lists both as a whole table and as structure only."""
    both = selection.filter(F.col("kind").isin(TABLE_KINDS)).groupBy("job_id", "name").agg(
        F.max(F.col("kind") == "table").alias("whole"), F.max(F.col("kind") == "structure").alias("bare")
    )
    return both.filter(F.col("whole") & F.col("bare")).select("job_id", "name")


def all_missing(selection: DataFrame, catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """Bag union of everything missing: both table lists, vanished and out-of-bounds files."""
    tables = missing_tables(selection, catalog).withColumn("reason", F.lit("no_table"))
    files = classify_files(selection, manifest).filter(F.col("class") != "kept")
    files = files.select("job_id", F.lit("file").alias("kind"), "ordinal", "name", F.col("class").alias("reason"))
    return tables.unionByName(files)


def strict_of(raw: Column) -> Column:
    """Absent means strict."""
    return F.coalesce(raw, F.lit("true")) == "true"


def skip_report(selection: DataFrame, manifest: DataFrame, requests: DataFrame) -> DataFrame:
    """Vanished files that a non-strict request drops and reports; tables are never skipped."""
    lenient = requests.filter(~strict_of(F.col("strict"))).select("job_id")
    vanished = classify_files(selection, manifest).filter(F.col("class") == "vanished")
    return vanished.join(lenient, "job_id", "left_semi").select("job_id", "ordinal", "name")


def _tasks(selection: DataFrame) -> int:
    entries = selection.count()
    width = int(selection.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(min(width, entries // FEWEST_PER_TASK + 1), -(-entries // ENTRIES_PER_TASK))


def selection_verdict(
    requests: DataFrame, selection: DataFrame, catalog: DataFrame, manifest: DataFrame, cap: int = SELECTION_CAP
) -> DataFrame:
    """One verdict per request; the first failing rule names it.

    ``requests`` has ``job_id`` and the raw text of ``strict`` and ``chunk_size`` (null when
    absent). Entries are first reduced to one row per request and name, so the joins see each name
    once, then to one row per request and share of its names, so a request of any size ends as few
    rows. Tasks are as many as the entries ask for, so what one of them holds doesn't grow.
    """
    kind, name = F.col("kind"), F.col("name")
    known_kind = kind.isin(*TABLE_KINDS, "file")
    bad_entry = name.isNull() | (name == "") | ~known_kind | kind.isNull()
    tasks = _tasks(selection)
    spread = selection.select("job_id", "kind", "name", F.pmod(F.xxhash64("name"), F.lit(SHARES)).alias("_share")).repartition(tasks, "job_id", "_share")
    per_name = spread.groupBy("job_id", "_share", "name").agg(
        F.count("*").alias("entries"),
        F.count_if(kind == "table").alias("whole"),
        F.count_if(kind == "structure").alias("bare"),
        F.count_if(kind == "file").alias("files"),
        F.max(bad_entry).alias("bad"),
    )
    is_table, is_file = F.col("whole") + F.col("bare") > 0, F.col("files") > 0
    hostile = F.col("hostile")
    checked = (
        per_name.withColumn("hostile", is_file & is_hostile(name))
        .withColumn("_path", scattered(F.when(is_file & ~hostile, resolved(name)), "job_id", "name"))
        .withColumn("_table", scattered(F.when(is_table, name), "job_id", "name"))
    )
    tables = catalog.select(F.col("name").alias("_table")).distinct().withColumn("in_catalog", F.lit(True))
    paths = _known_paths(manifest, "on_disk")
    checked = checked.join(tables, "_table", "left").join(paths, "_path", "left")
    repeated = (F.col("whole") > 1) | (F.col("bare") > 1) | (F.col("files") > 1)
    vanished = is_file & ~hostile & F.col("on_disk").isNull()
    flags = {
        "malformed": F.col("bad") | repeated,
        "overlap": (F.col("whole") > 0) & (F.col("bare") > 0),
        "restricted": is_file & is_restricted(name),
        "no_table": is_table & F.col("in_catalog").isNull(),
        "out_of_bounds": hostile | (is_file & ~F.coalesce("on_disk", F.lit(True))),
        "vanished": vanished,
        "has_table": is_table,
        "has_kept": is_file & ~hostile & F.coalesce("on_disk", F.lit(False)),
    }
    per_share = checked.groupBy("job_id", "_share").agg(F.sum("entries").alias("entries"), *(F.max(flag).alias(x) for x, flag in flags.items()))
    per_job = per_share.repartition(tasks, "job_id").groupBy("job_id").agg(F.sum("entries").alias("entries"), *(F.max(x).alias(x) for x in flags))
    strict = strict_of(F.col("strict"))
    bad_flag = F.col("strict").isNotNull() & ~F.col("strict").isin("true", "false")
    size = F.col("chunk_size")
    bad_size = size.isNotNull() & ~(size.rlike(r"^[0-9]+$") & ~size.rlike(r"^0+$"))
    nothing_left = ~F.col("has_table") & ~F.col("has_kept")
    unknown = F.col("no_table") | F.col("out_of_bounds") | (strict & F.col("vanished")) | (~strict & nothing_left)
    verdict = (
        F.when(F.col("entries").isNull() | F.col("malformed"), "malformed")
        .when(F.col("entries") > cap, "too_large")
        .when(F.col("overlap"), "overlap")
        .when(bad_flag, "bad_flag")
        .when(bad_size, "bad_size")
        .when(F.col("restricted"), "restricted")
        .when(unknown, "unknown")
        .otherwise("ok")
    )
    joined = requests.join(per_job, "job_id", "left")
    return joined.select("job_id", F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries"), verdict.alias("verdict"))


def distinct_first(df: DataFrame, group: list[str], value: str, position: Column) -> DataFrame:
    """Distinct values of a group with the position each was first seen at."""
    return df.groupBy(*group, value).agg(F.min(position).alias("first_seen"))
