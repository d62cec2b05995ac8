"""Silence and expiry on a live job journal, from extremes that merge in any order of files.

What an alert depends on is a job's newest event, its first time and its latest progress. Each is an extreme, so a batch
merges into what earlier batches left, and no row is lost for coming late. An alert holds once its due second is
``lateness`` behind the newest event; rows that come later still may revoke it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parcelry.operators.journal import LIFETIME_TTLS, STALE_SECONDS, TTL_SECONDS, is_terminal
from parcelry.streaming.ledger import Ledger
from parcelry.streaming.run import start_batches, write_batch

ALERT_SCHEMA = "job_id bigint, alert string, state string, updated_at bigint, due_at bigint, revoked boolean"
ALERTS = ["stale", "expired"]
LATENESS = 600
LONG, TEXT = T.LongType(), T.StringType()
NEWEST = T.StructType([T.StructField("ts", LONG), T.StructField("event_id", LONG), T.StructField("state", TEXT)])
JOBS = T.StructType(
    [
        T.StructField("job_id", LONG),
        T.StructField("newest", NEWEST),
        *[T.StructField(name, LONG) for name in ("created_at", "progressed_at", "was_stale", "was_expired")],
    ]
)
ROWS = T.StructType(
    [
        *[T.StructField(name, LONG) for name in ("job_id", "ts", "event_id")],
        *[T.StructField(name, TEXT) for name in ("kind", "state")],
    ]
)


def _due(mark: int | None, stale: int, ttl: int, lifetime: int) -> dict[str, Column]:
    """First second each alert holds, null if the state rules it out or the second lies beyond ``mark``."""
    state, updated = F.col("newest.state"), F.col("newest.ts")
    silent = F.when(state == "queued", updated + 1).when(state == "running", updated + stale + 1)
    gone = F.least(updated + ttl, F.coalesce("progressed_at", "created_at") + lifetime) + 1
    expired = F.when(~is_terminal(state) | (state == "failed"), gone)
    reached = lambda due: F.when(due <= F.lit(mark).cast("bigint"), due)
    return {"stale": reached(silent), "expired": reached(expired)}


def _mark(jobs: DataFrame, lateness: int) -> int | None:
    newest = jobs.agg(F.max("newest.ts")).first()[0]
    return None if newest is None else newest - lateness


def _limits(stale: int, ttl: int, lifetime: int | None) -> tuple[int, int, int]:
    ttl = max(1, ttl)
    return stale, ttl, max(ttl, ttl * LIFETIME_TTLS if lifetime is None else lifetime)


def monitor_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    stale: int = STALE_SECONDS,
    ttl: int = TTL_SECONDS,
    lifetime: int | None = None,
    lateness: int = LATENESS,
) -> StreamingQuery:
    """Writes the alerts that each batch raises or revokes; ``events`` has job_id, ts (Unix seconds), event_id, kind and state."""
    limits = _limits(stale, ttl, lifetime)

    def watch(batch: DataFrame, batch_id: int) -> None:
        ledger, none = Ledger(batch.sparkSession, path), F.lit(None).cast("bigint")
        known = ledger.read("jobs", batch_id - 1, JOBS)
        before = _mark(known, lateness)
        rows = batch.select(*ROWS.fieldNames())
        ledger.write(rows.filter(F.col("ts") <= F.lit(before).cast("bigint")), "late", batch_id)
        held = _due(before, *limits)
        kept = known.select("job_id", "newest", "created_at", "progressed_at", held["stale"].alias("was_stale"), held["expired"].alias("was_expired"))
        came = rows.select(
            "job_id", F.struct("ts", "event_id", "state").alias("newest"), F.col("ts").alias("created_at"),
            F.when(F.col("kind") == "advance", F.col("ts")).alias("progressed_at"), none.alias("was_stale"), none.alias("was_expired"),
        )
        merged = kept.unionByName(came).groupBy("job_id").agg(
            F.max("newest").alias("newest"), F.min("created_at").alias("created_at"),
            *[F.max(name).alias(name) for name in ("progressed_at", "was_stale", "was_expired")],
        )
        ledger.write(merged, "jobs", batch_id)
        jobs = ledger.read("jobs", batch_id, JOBS)
        write_batch(_changes(jobs, _due(_mark(jobs, lateness), *limits)), path, batch_id)

    return start_batches(events, watch, checkpoint, trigger=trigger)


def _changes(jobs: DataFrame, due: dict[str, Column]) -> DataFrame:
    """An alert with another due second is revoked and raised anew."""
    moves = []
    for alert in ALERTS:
        was, now = F.col(f"was_{alert}"), due[alert]
        changed = ~was.eqNullSafe(now)
        for at, revoked in ((was, True), (now, False)):
            moves.append(F.when(changed & at.isNotNull(), F.struct(F.lit(alert).alias("alert"), at.alias("due_at"), F.lit(revoked).alias("revoked"))))
    moved = jobs.select("job_id", "newest", F.explode(F.filter(F.array(*moves), lambda move: move.isNotNull())).alias("move"))
    return moved.select(
        "job_id", "move.alert", F.col("newest.state").alias("state"), F.col("newest.ts").alias("updated_at"), "move.due_at", "move.revoked"
    )


def standing_alerts(
    spark: SparkSession, path: str, stale: int = STALE_SECONDS, ttl: int = TTL_SECONDS, lifetime: int | None = None, lateness: int = LATENESS
) -> DataFrame:
    """The alerts that hold after the last batch: those of the whole journal, however its rows came."""
    ledger = Ledger(spark, path)
    jobs = ledger.read("jobs", ledger.last("jobs"), JOBS)
    nothing = F.lit(None).cast("bigint")
    return _changes(jobs.withColumns({f"was_{a}": nothing for a in ALERTS}), _due(_mark(jobs, lateness), *_limits(stale, ttl, lifetime))).drop("revoked")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows that came behind the mark; they count all the same."""
    return Ledger(spark, path).every("late", ROWS)
