"""One audit entry per ready job, exactly once, from a stream of ready events in any order.

A job's earliest event waits in the ledger until events are ``hold`` seconds past it, or until the stream is settled;
nothing is dropped for coming late. Which jobs are audited stands in the ledger beside the log, in buckets by hash of
the job, so neither a batch nor a run with a new checkpoint reads the log's entries again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parcelry.sources.audit_log import AUDIT_SCHEMA, append_audit, read_audit, utc_day
from parcelry.streaming.ledger import Ledger
from parcelry.streaming.run import start_batches

HOLD_SECONDS = 600
BUCKETS = 64
MARK = T.StructType([T.StructField("mark", T.LongType())])
DONE = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("bucket", T.IntegerType())])


def _root(path: str) -> str:
    return f"{path.rstrip('/')}-ledger"


def _run(spark: SparkSession, path: str, checkpoint: str) -> Ledger:
    """The ledger of one run of the stream: what waits, and how far events have come."""
    return Ledger(spark, f"{_root(path)}/{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}")


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int"))


def _audited(spark: SparkSession, path: str, own: str, batch_id: int) -> DataFrame:
    """(job_id, ts, seq, bucket) that any other batch of any run has audited."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{_root(path)}/done")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], DONE)
    schema = T.StructType([*DONE.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{_root(path)}/done").filter((F.col("run") != own) | (F.col("batch") != batch_id))


def _release(ledger: Ledger, path: str, merged: DataFrame, mark: int | None, batch_id: int) -> None:
    """Appends the entries up to ``mark`` (all of them if None), keeps the rest waiting, and lists what came too late."""
    spark, own = ledger.spark, ledger.root.rsplit("/", 1)[-1]
    known = _audited(spark, path, own, batch_id).select("bucket", "job_id", F.col("ts").alias("_ts"), F.col("seq").alias("_seq"))
    judged = _bucketed(merged).join(known, ["bucket", "job_id"], "left")
    fresh = judged.filter("_ts IS NULL").drop("_ts", "_seq")
    due = F.lit(True) if mark is None else F.col("ts") <= mark
    done = f"{_root(path)}/done/run={own}/batch={batch_id}"
    fresh.filter(due).select(*DONE.fieldNames()).repartition("bucket").write.mode("overwrite").parquet(done)
    ledger.write(judged.filter("ts < _ts OR ts = _ts AND seq < _seq").select(*AUDIT_SCHEMA.fieldNames()), "late", batch_id)
    ledger.write(fresh.filter(~due).select(*AUDIT_SCHEMA.fieldNames()), "waiting", batch_id)
    # A batch that runs again may have appended already; only the days of its own entries are looked through.
    entries = merged.join(spark.read.schema(DONE).parquet(done).select("job_id"), "job_id", "left_semi")
    days = [r["day"] for r in entries.select(utc_day(F.col("ts")).alias("day")).distinct().collect()]
    if days:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            written = read_audit(spark, path).filter(F.col("day").isin(days)).select("job_id")
            entries = entries.join(written, "job_id", "left_anti")
        append_audit(entries, path)


def audit_stream(ready: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, hold: int | None = HOLD_SECONDS) -> StreamingQuery:
    """Appends entries of ready events (the audit columns, one event per row): of each job the earliest by (ts, seq).

    ``hold`` is how many seconds events may be out of order; None keeps all entries until ``settle_audit``, whatever
    the order. An event earlier than its job's appended entry is listed by ``late_entries``.
    """

    def record(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ledger = _run(spark, path, checkpoint)
        waiting = ledger.read("waiting", batch_id - 1, AUDIT_SCHEMA)
        names = [F.col(c) if c in batch.columns else F.lit(None).cast(AUDIT_SCHEMA[c].dataType).alias(c) for c in AUDIT_SCHEMA.fieldNames()]
        both = waiting.unionByName(batch.select(*names))
        merged = both.groupBy("job_id").agg(F.min_by(F.struct(*AUDIT_SCHEMA.fieldNames()), F.struct("ts", "seq")).alias("entry")).select("entry.*")
        before = ledger.read("mark", batch_id - 1, MARK).first()
        newest = batch.agg(F.max("ts")).first()[0]
        mark = max(-1 if newest is None else newest, before["mark"] if before else -1)
        ledger.write(spark.range(1).select(F.lit(mark).cast("long").alias("mark")), "mark", batch_id)
        _release(ledger, path, merged, -1 if hold is None else mark - hold, batch_id)

    return start_batches(ready, record, checkpoint, trigger=trigger)


def settle_audit(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Appends every entry still waiting, for a stream that has ended."""
    ledger = _run(spark, path, checkpoint)
    last = ledger.last("waiting")
    _release(ledger, path, ledger.read("waiting", last, AUDIT_SCHEMA), None, last + 1)


def late_entries(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Events that came after a later event of their job was audited."""
    return _run(spark, path, checkpoint).every("late", AUDIT_SCHEMA)
