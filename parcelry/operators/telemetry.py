"""Run telemetry from progress samples and phase timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelry.operators.ordered import HOT_ROWS, find_hot, previous_in_group

# The phases a chunk is timed in; ``total`` spans the chunk.
PHASES = ["open", "resume", "resolve", "read", "seal", "suspend", "save"]
PAUSE_SECONDS = 60
RATE_SECONDS = 600


def phase_totals(timings: DataFrame, group: Sequence[str] = ("job_id",)) -> DataFrame:
    """Microseconds per phase and the part of the total no phase explains.

    Phases not in the known list still count as named time.
    """
    spent = timings.select(*group, F.explode("phases").alias("phase", "us"))
    summed = spent.groupBy(*group, "phase").agg(F.sum("us").alias("us"))
    wide = [F.coalesce(F.sum(F.when(F.col("phase") == p, F.col("us"))), F.lit(0)).alias(p) for p in [*PHASES, "total"]]
    named = F.coalesce(F.sum(F.when(F.col("phase") != "total", F.col("us"))), F.lit(0))
    totals = summed.groupBy(*group).agg(*wide, named.alias("_named"))
    return totals.withColumn("unattributed", F.col("total") - F.col("_named")).drop("_named")


def cost_per_part(samples: DataFrame) -> DataFrame:
    """Wall clock, parts and seconds per part of every run, with its chunk size."""
    runs = samples.groupBy("chunk_size", "series").agg(
        (F.max("epoch") - F.min("epoch")).alias("wall_s"), F.max("chunks_done").alias("parts")
    )
    per_part = F.when(F.col("parts") > 0, F.col("wall_s").cast("double") / F.col("parts"))
    return runs.withColumn("s_per_part", per_part)


def pause_share(samples: DataFrame, pause: int = PAUSE_SECONDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Seconds in gaps of at least ``pause`` without progress, over the observed time.

    Progress is a sample that raises ``chunks_done``; the run's first and last samples bound
    the gaps at either end.
    """
    order = ["epoch", "sample_id"]
    heat = find_hot(samples, ["series"], hot_rows)
    moved = previous_in_group(samples, ["series"], order, {"before": "chunks_done"}, heat)
    ends = samples.groupBy("series").agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"))
    marks = moved.filter(F.col("before").isNull() | (F.col("chunks_done") > F.col("before"))).select(
        "series", "epoch", "sample_id"
    )
    tail = ends.select("series", F.col("last").alias("epoch"), F.lit(None).cast("bigint").alias("sample_id"))
    # The closing mark sorts after every real one of the same second.
    closing = [F.col("epoch"), F.col("sample_id").asc_nulls_last()]
    gaps = previous_in_group(marks.unionByName(tail), ["series"], closing, {"since": "epoch"}, heat)
    gap = F.col("epoch") - F.col("since")
    paused = gaps.groupBy("series").agg(
        F.coalesce(F.sum(F.when(gap >= pause, gap)), F.lit(0)).alias("paused_s")
    )
    spans = ends.select("series", (F.col("last") - F.col("first")).alias("elapsed_s"))
    share = F.when(F.col("elapsed_s") > 0, F.col("paused_s").cast("double") / F.col("elapsed_s"))
    return paused.join(spans, "series").withColumn("share", share)


def best_rate(progress: DataFrame, seconds: int = RATE_SECONDS) -> DataFrame:
    """Best sustained rate per series: most units done in any window of ``seconds``.

    ``progress`` has ``(series, epoch, units)``, units done at that moment. Each row is also
    seen by the next time bucket, so a series is windowed bucket by bucket, never in one task;
    rows of one second are summed before that.
    """
    per_second = progress.groupBy("series", "epoch").agg(F.sum("units").alias("units"))
    bucket = F.floor(F.col("epoch") / F.lit(seconds)).cast("bigint")
    seen = per_second.withColumn("_own", bucket).withColumn("_bucket", F.explode(F.array(bucket, bucket + 1)))
    trailing = Window.partitionBy("series", "_bucket").orderBy("epoch").rangeBetween(-(seconds - 1), 0)
    windows = seen.withColumn("done", F.sum("units").over(trailing)).filter(F.col("_own") == F.col("_bucket"))
    best = windows.groupBy("series").agg(F.max("done").alias("best_units"))
    return best.withColumn("per_second", F.col("best_units").cast("double") / F.lit(seconds))


def rate_windows(progress: DataFrame, length: str = "10 minutes", step: str = "1 minute") -> DataFrame:
    """Units done per sliding window; the same plan on a stream that carries a watermark.

    ``progress`` has ``(series, event_time, units)``.
    """
    windows = progress.groupBy("series", F.window("event_time", length, step)).agg(F.sum("units").alias("units"))
    return windows.select("series", F.col("window.start").alias("start"), "units")


def multipart_share(attempts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Share of a run's time spent on files that needed more than one part.

    An attempt's time runs until the next one of the same job.
    """
    newest_first = [F.desc("epoch"), F.desc("event_id")]
    timed = previous_in_group(attempts, ["job_id"], newest_first, {"until": "epoch"}, hot_rows)
    per_file = timed.groupBy("job_id", "n").agg(
        F.coalesce(F.sum(F.col("until") - F.col("epoch")), F.lit(0)).alias("seconds"),
        F.max(F.col("offset") > 0).alias("multipart"),
    )
    per_job = per_file.groupBy("job_id").agg(
        F.sum(F.when(F.col("multipart"), F.col("seconds")).otherwise(F.lit(0))).alias("multipart_s"),
        F.sum("seconds").alias("elapsed_s"),
    )
    share = F.when(F.col("elapsed_s") > 0, F.col("multipart_s").cast("double") / F.col("elapsed_s"))
    return per_job.withColumn("share", share)
