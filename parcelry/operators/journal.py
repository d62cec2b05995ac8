"""Audit and job journals: listing, retention, expiry, stalls, orphans and lifecycle checks.

Times are Unix seconds, as the records hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.functions.scalars import bounded_message
from parcelry.operators.ordered import HOT_ROWS, previous_in_group, running_sum_in_group

STALE_SECONDS = 120
STALL_ATTEMPTS = 2
TTL_SECONDS = 3600
LIFETIME_TTLS = 6
RETENTION_DAYS = 90
RING = 8

# The states of a job, the final ones, and the moves each state allows.
STATES = ["queued", "running", "ready", "consumed", "failed", "cancelled", "expired"]
TERMINAL_STATES = ["consumed", "failed", "cancelled", "expired"]
LEGAL_MOVES = {
    "queued": ["queued", "running", "cancelled", "expired"],
    "running": ["running", "ready", "failed", "cancelled", "expired"],
    "ready": ["ready", "consumed", "cancelled", "expired"],
}
# Fixed value: the shape of an artifact's file name.
ARTIFACT_PATTERN = r"(?d)^[a-f0-9]{32}\.sealed$"


def is_terminal(state: Column) -> Column:
    return state.isin(TERMINAL_STATES)


def list_jobs(jobs: DataFrame, owners: DataFrame, include_terminal: bool = False) -> DataFrame:
    """The jobs of the given owners; a finished job is listed only on request, without progress."""
    own = jobs.join(owners.select("owner").distinct(), "owner", "left_semi")
    done = is_terminal(F.col("state"))
    if not include_terminal:
        own = own.filter(~done)
    progress = [name for name in jobs.columns if name.endswith(("_done", "_total"))]
    live = {name: F.when(~done, F.col(name)).alias(name) for name in progress}
    base = ["job_id", "owner", "state", "created_at", "updated_at"]
    return own.select(*base, *live.values())


def retain(df: DataFrame, now: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Entries younger than the window; an entry without a readable time is dropped."""
    cutoff = now - max(0, days) * 86400
    kept = F.col("ts") > F.lit(cutoff)
    if "day" in df.columns:
        kept = kept & (F.col("day") >= F.to_date(F.timestamp_seconds(F.lit(cutoff))))
    return df.filter(kept)


def expired(jobs: DataFrame, now: int, ttl: int = TTL_SECONDS, lifetime: int | None = None) -> DataFrame:
    """Unfinished or failed jobs that went silent, or made no progress for a lifetime."""
    ttl = max(1, ttl)
    lifetime = max(ttl, ttl * LIFETIME_TTLS if lifetime is None else lifetime)
    reclaimable = ~is_terminal(F.col("state")) | (F.col("state") == "failed")
    silent = F.lit(now) - F.col("updated_at") > ttl
    outlived = F.lit(now) - F.coalesce("progressed_at", "created_at") > lifetime
    return jobs.filter(reclaimable & (silent | outlived))


def needs_advance(jobs: DataFrame, now: int, stale: int = STALE_SECONDS) -> DataFrame:
    """Queued jobs, and running ones that have been silent too long."""
    silent = F.lit(now) - F.col("updated_at") > stale
    return jobs.filter((F.col("state") == "queued") | ((F.col("state") == "running") & silent))


def orphans(artifacts: DataFrame, jobs: DataFrame, now: int, ttl: int = TTL_SECONDS) -> DataFrame:
    """Artifacts of the right shape that no job claims and that are past their grace period."""
    shaped = artifacts.filter(F.col("artifact").rlike(ARTIFACT_PATTERN) & (F.lit(now) - F.col("mtime") > ttl))
    return shaped.join(jobs.select("artifact"), "artifact", "left_anti")


def resolve_attempts(attempts: DataFrame, selection: DataFrame) -> DataFrame:
    """The selected name an attempt was working on; the index attempt has none."""
    names = selection.select("job_id", "kind", F.col("ordinal").alias("n"), "name")
    return attempts.join(names, ["job_id", "kind", "n"], "left")


def attempt_messages(resolved: DataFrame, message: Column) -> DataFrame:
    return resolved.withColumn("message", bounded_message(message))


def with_login(df: DataFrame, users: DataFrame) -> DataFrame:
    """Adds the login of ``user_id``, empty when the user no longer exists."""
    joined = df.join(users.select("user_id", F.col("login").alias("_login")), "user_id", "left")
    return joined.withColumn("user_login", F.coalesce("_login", F.lit(""))).drop("_login")


def last_n(df: DataFrame, n: int = RING, group: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last ``n`` events per job; Spark limits each group map-side before it shuffles."""
    newest = Window.partitionBy(group).orderBy(*[F.desc(name) for name in order])
    return df.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)


def stall_runs(events: DataFrame, hot_rows: int = HOT_ROWS, max_attempts: int = STALL_ATTEMPTS) -> DataFrame:
    """Attempts begun between real advances, and whether each run of them is a stall.

    ``events`` has ``kind`` ``attempt`` or ``advance``; run 0 precedes the first advance.
    """
    advance = (F.col("kind") == "advance").cast("bigint")
    runs = running_sum_in_group(events, ["job_id"], ["ts", "event_id"], {"run": advance}, hot_rows)
    counted = runs.groupBy("job_id", "run").agg(F.count_if(F.col("kind") == "attempt").alias("attempts"))
    return counted.withColumn("stalled", F.col("attempts") >= max_attempts)


def illegal_transitions(states: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """State changes the lifecycle forbids; a final state is never left."""
    moves = previous_in_group(states, ["job_id"], ["ts", "event_id"], {"from_state": "state"}, hot_rows)
    legal = F.lit(False)
    for source, targets in LEGAL_MOVES.items():
        legal = legal | ((F.col("from_state") == source) & F.col("state").isin(targets))
    return moves.filter(F.col("from_state").isNotNull() & ~legal)


def progress(segments: DataFrame, selection: DataFrame, jobs: DataFrame) -> DataFrame:
    """Tables and files done and selected, and chunks sealed; only running and ready jobs report.

    ``segments`` has ``(job_id, kind, ordinal, last)`` per sealed chunk. Chunks are reduced to
    one row per resource before they are counted per job.
    """
    table_like = F.col("kind").isin("table", "structure")
    sealed = segments.groupBy("job_id", "kind", "ordinal").agg(
        F.count("*").alias("chunks"), F.max("last").alias("whole")
    )
    done = sealed.groupBy("job_id").agg(
        F.count_if(table_like & F.col("whole")).alias("tables_sealed"),
        F.count_if((F.col("kind") == "file") & F.col("whole")).alias("files_sealed"),
        F.sum("chunks").alias("chunks"),
    )
    total = selection.groupBy("job_id").agg(
        F.count_if(table_like).alias("tables_total"), F.count_if(F.col("kind") == "file").alias("files_total")
    )
    joined = jobs.join(total, "job_id", "left").join(done, "job_id", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint")
    ready = F.col("state") == "ready"
    return joined.filter(F.col("state").isin("running", "ready")).select(
        "job_id",
        "state",
        F.when(ready, zero("tables_total")).otherwise(zero("tables_sealed")).alias("tables_done"),
        zero("tables_total").alias("tables_total"),
        F.when(ready, zero("files_total")).otherwise(zero("files_sealed")).alias("files_done"),
        zero("files_total").alias("files_total"),
        zero("chunks").alias("chunks_done"),
    )
