"""Streaming queries: each drains the table's files through a stream and reads what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.plans import sql_text as sql
from parcelry.plans.bindings import journal_of, table_stream
from parcelry.plans.journals import BUDGETS_SQL, entries_of, stall_events
from parcelry.plans.registry import ORACLES, query
from parcelry.plans.tables import ORDERS_DDL  # noqa: F401  (registers the table queries first)
from parcelry.session import scratch_path
from parcelry.sources.audit_log import read_audit
from parcelry.streaming.adapt import advise_stream, latest_advice
from parcelry.streaming.audit import audit_stream, settle_audit
from parcelry.streaming.extract import extract_stream, finish_extract, read_extracted
from parcelry.streaming.monitor import monitor_stream, standing_alerts


@query("stream_extract", ORACLES["table_segments"])
def _extract(spark: SparkSession, sf: str) -> DataFrame:
    path, checkpoint = scratch_path(spark, "stream-extract"), scratch_path(spark, "checkpoint")
    orders = table_stream(spark, sf, "orders")
    extract_stream(orders, "orders", ["o_orderkey"], path, checkpoint).awaitTermination()
    finish_extract(spark, orders.schema, "orders", ["o_orderkey"], path)
    return read_extracted(spark, path).select(
        "part", "name", F.octet_length("payload").cast("bigint").alias("bytes"), F.md5("payload").alias("payload_md5")
    )


@query("stall_adapt", BUDGETS_SQL)
def _adapt(spark: SparkSession, sf: str) -> DataFrame:
    path, checkpoint = scratch_path(spark, "stream-adapt"), scratch_path(spark, "checkpoint")
    steps = stall_events(journal_of(table_stream(spark, sf, "events")))
    advise_stream(steps, path, checkpoint).awaitTermination()
    return latest_advice(spark, path)


@query(
    "stream_expiry",
    f"""with {sql.JOBS}, mark as (select max(ts) - 600 as now from journal)
select job_id, state, updated_at from jobs, mark
where now - updated_at > 3600 or now - coalesce(progressed_at, created_at) > 21600""",
)
def _expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs the stream's mark has left behind when it is drained."""
    path, checkpoint = scratch_path(spark, "stream-expiry"), scratch_path(spark, "checkpoint")
    monitor_stream(journal_of(table_stream(spark, sf, "events")), path, checkpoint).awaitTermination()
    return standing_alerts(spark, path).filter(F.col("alert") == "expired").select("job_id", "state", "updated_at")


@query("stream_audit", f"with {sql.JOURNAL} select job_id, min(ts) as ts from journal where state = 'ready' group by job_id")
def _audit(spark: SparkSession, sf: str) -> DataFrame:
    path, checkpoint = scratch_path(spark, "stream-audit"), scratch_path(spark, "checkpoint")
    audit_stream(entries_of(journal_of(table_stream(spark, sf, "events"))), path, checkpoint, hold=None).awaitTermination()
    settle_audit(spark, path, checkpoint)
    return read_audit(spark, path).select("job_id", "ts")
