"""Run-telemetry queries over progress series derived from the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.operators import telemetry
from parcelry.operators.ordered import running_sum_in_group
from parcelry.plans import sql_text as sql
from parcelry.plans.bindings import journal
from parcelry.plans.registry import query
from parcelry.session import scratch_path
from parcelry.sources.samples import read_samples

SAMPLES_SQL = f"""{sql.JOURNAL}, samples as (
  select job_id as series, event_id as sample_id, ts as epoch, state, cast(262144 * pow(2, job_id % 4) as bigint) as chunk_size,
    cast(sum(cast(kind = 'advance' as int)) over along as bigint) as chunks_done, cast(sum(cast(state = 'ready' as int)) over along as bigint) as files_done
  from journal window along as (partition by job_id order by ts, event_id rows unbounded preceding))"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Progress samples of a run per job, with running counters."""
    counters = {"chunks_done": (F.col("kind") == "advance").cast("bigint"), "files_done": (F.col("state") == "ready").cast("bigint")}
    counted = running_sum_in_group(journal(spark, sf), ["job_id"], ["ts", "event_id"], counters)
    size = F.element_at(F.array(*[F.lit(262144 << i).cast("bigint") for i in range(4)]), (F.col("job_id") % 4 + 1).cast("int"))
    return counted.select(
        F.col("job_id").alias("series"), F.col("event_id").alias("sample_id"), F.col("ts").alias("epoch"), "state",
        size.alias("chunk_size"), "chunks_done", "files_done",
    )


@query(
    "phase_totals",
    f"""with {sql.JOURNAL} select job_id, cast(0 as bigint) as open, cast(0 as bigint) as resume, cast(sum(k) as bigint) as resolve,
  cast(sum(us // 3) as bigint) as read, cast(sum(us // 4) as bigint) as seal, cast(0 as bigint) as suspend, cast(0 as bigint) as save,
  cast(sum(us) as bigint) as total, cast(sum(us - k - us // 3 - us // 4) as bigint) as unattributed from journal group by job_id""",
)
def _phases(spark: SparkSession, sf: str) -> DataFrame:
    us = F.col("us")
    phases = F.create_map(
        F.lit("total"), us, F.lit("resolve"), F.col("k"),
        F.lit("read"), F.floor(us / 3).cast("bigint"), F.lit("seal"), F.floor(us / 4).cast("bigint"),
    )
    return telemetry.phase_totals(journal(spark, sf).select("job_id", phases.alias("phases")))


@query(
    "cost_per_part",
    f"""with {SAMPLES_SQL}, runs as (
  select chunk_size, series, max(epoch) - min(epoch) as wall_s, max(chunks_done) as parts from samples group by 1, 2)
select *, coalesce(cast(wall_s as double) / nullif(parts, 0), -1) as s_per_part from runs""",
)
def _cost(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.cost_per_part(samples(spark, sf)).fillna(-1.0, ["s_per_part"])


@query(
    "pause_share",
    f"""with {SAMPLES_SQL}, moved as (
  select *, lag(chunks_done) over (partition by series order by epoch, sample_id) as before from samples),
marks as (
  select series, epoch, 0 as closing, sample_id from moved where before is null or chunks_done > before
  union all select series, max(epoch), 1, null from samples group by series),
gaps as (select series, epoch - lag(epoch) over (partition by series order by epoch, closing, sample_id) as gap from marks),
paused as (select series, cast(coalesce(sum(gap) filter (gap >= 60), 0) as bigint) as paused_s from gaps group by series),
spans as (select series, max(epoch) - min(epoch) as elapsed_s from samples group by series)
select series, paused_s, elapsed_s, cast(paused_s as double) / elapsed_s as share from paused join spans using (series)""",
)
def _pauses(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.pause_share(samples(spark, sf))


@query(
    "best_rate",
    f"""with {sql.JOURNAL}, per_second as (select kind as series, ts as epoch, count(*) as units from journal group by 1, 2),
windows as (select series, sum(units) over (partition by series order by epoch range between 599 preceding and current row) as done from per_second)
select series, cast(max(done) as bigint) as best_units, cast(max(done) as double) / 600 as per_second from windows group by series""",
)
def _rate(spark: SparkSession, sf: str) -> DataFrame:
    units = journal(spark, sf).select(F.col("kind").alias("series"), F.col("ts").alias("epoch"), F.lit(1).cast("bigint").alias("units"))
    return telemetry.best_rate(units)


@query(
    "rate_windows",
    f"""with {sql.JOURNAL}, seen as (select kind as series, (ts // 60) * 60 - 60 * unnest(range(10)) as start from journal)
select series, cast(start as bigint) as start, count(*) as units from seen group by 1, 2""",
)
def _windows(spark: SparkSession, sf: str) -> DataFrame:
    units = journal(spark, sf).select(F.col("kind").alias("series"), F.timestamp_seconds("ts").alias("event_time"), F.lit(1).cast("bigint").alias("units"))
    return telemetry.rate_windows(units).withColumn("start", F.unix_seconds("start"))


@query(
    "multipart_share",
    f"""with {sql.JOURNAL}, timed as (
  select job_id, k % 10 as n, us > 25000 as later_part, lead(ts) over (partition by job_id order by ts, event_id) - ts as seconds from journal where kind = 'attempt'),
per_file as (select job_id, n, coalesce(sum(seconds), 0) as seconds, bool_or(later_part) as multipart from timed group by 1, 2),
per_job as (select job_id, cast(coalesce(sum(seconds) filter (multipart), 0) as bigint) as multipart_s, cast(sum(seconds) as bigint) as elapsed_s from per_file group by 1)
select *, coalesce(cast(multipart_s as double) / nullif(elapsed_s, 0), -1) as share from per_job""",
)
def _multipart(spark: SparkSession, sf: str) -> DataFrame:
    attempts = journal(spark, sf).filter(F.col("kind") == "attempt").select(
        "job_id", F.col("ts").alias("epoch"), "event_id", (F.col("k") % 10).alias("n"),
        F.when(F.col("us") > 25000, 262144).otherwise(0).alias("offset"),
    )
    return telemetry.multipart_share(attempts).fillna(-1.0, ["share"])


@query(
    "read_samples",
    f"with {SAMPLES_SQL} select 'run=' || chunk_size as series, epoch, state, files_done, chunks_done from samples",
)
def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """The samples written as one CSV folder per chunk size and read back with the fixed schema."""
    root = scratch_path(spark, "samples")
    zero = F.lit(0)
    written = samples(spark, sf).select(
        F.col("chunk_size").alias("run"), F.pmod("sample_id", F.lit(16)).alias("salt"), "epoch", F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"),
        "state", zero.alias("tables_done"), zero.alias("tables_total"), "files_done", zero.alias("files_total"), "chunks_done",
        F.lit("200").alias("http"),
    )
    # The salt spreads a long series over several files of its folder.
    written.repartition("run", "salt").drop("salt").write.partitionBy("run").option("header", "true").csv(root)
    return read_samples(spark, root).select("series", "epoch", "state", "files_done", "chunks_done")
