"""Budget advice on a live attempt journal, folded in event order whatever the order of files.

Every batch's steps stay in a ledger. Once events are ``hold`` seconds past a step, it is folded into its job's counters; a
step that comes after that has its job folded anew from the ledger, so advice is revised and never wrong for good.
"""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parcelry.operators.budgets import EARLIEST, Budgets, fold_stalls
from parcelry.streaming.ledger import Ledger
from parcelry.streaming.run import start_batches, write_batch

HOLD_SECONDS = 600
LONG, TEXT = T.LongType(), T.StringType()
STEPS = T.StructType([*[T.StructField(n, LONG) for n in ("job_id", "ts", "event_id")], *[T.StructField(n, TEXT) for n in ("kind", "spends")]])
STATE = T.StructType(
    [
        T.StructField("job_id", LONG),
        T.StructField("fruitless", T.IntegerType()),
        T.StructField("files", LONG),
        T.StructField("tables", LONG),
        T.StructField("failed", T.BooleanType()),
    ]
)
#: Newest step seen, the time up to which steps are folded, the batch whose state holds them, and the bounds jobs start from.
HEAD = T.StructType([T.StructField(n, LONG) for n in ("newest", "folded", "state", "file_bytes", "table_bytes", "table_rows", "max_attempts")])


def advise_stream(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, hold: int = HOLD_SECONDS, **bounds: int
) -> StreamingQuery:
    """Streaming twin of the batch budgets: writes the advice of each job that a batch folds steps of.

    A step without a time goes before all others, as in the batch form.
    """
    start = Budgets(**bounds)

    def record(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ledger = Ledger(spark, path)
        timed = batch.filter(F.col("kind").isin("attempt", "advance")).withColumn("ts", F.coalesce("ts", F.lit(EARLIEST + 1)))
        ledger.write(timed.select(*STEPS.fieldNames()), "steps", batch_id)
        came = ledger.read("steps", batch_id, STEPS)
        newest = came.agg(F.max("ts")).first()[0]
        before = ledger.read("head", batch_id - 1, HEAD).first()
        newest, folded, held = (
            (max(before["newest"], EARLIEST if newest is None else newest), before["folded"], before["state"]) if before else (newest or 0, EARLIEST, -1)
        )
        upto = max(folded, newest - hold)
        behind = came.filter(F.col("ts") <= folded).select("job_id").distinct()
        if upto > folded or not behind.isEmpty():
            steps, known = ledger.every("steps", STEPS), ledger.read("state", held, STATE)
            again = steps.filter(F.col("ts") <= folded).join(behind, "job_id", "left_semi")
            due = steps.filter((F.col("ts") > folded) & (F.col("ts") <= upto)).unionByName(again)
            carried = known.join(behind, "job_id", "left_anti")
            ledger.write(fold_stalls(due, start, carried).select(*STATE.fieldNames()), "state", batch_id)
            changed = ledger.read("state", batch_id, STATE).join(due.select("job_id").distinct(), "job_id", "left_semi")
            write_batch(start.advice(changed), path, batch_id)
            held = batch_id
        ledger.write(spark.createDataFrame([(newest, upto, held, *astuple(start))], HEAD), "head", batch_id)

    return start_batches(events, record, checkpoint, trigger=trigger)


def latest_advice(spark: SparkSession, path: str) -> DataFrame:
    """Advice per job from every step so far, those still held back included; it changes nothing in the ledger."""
    ledger = Ledger(spark, path)
    head = ledger.read("head", ledger.last("head"), HEAD).first()
    if head is None:
        none = spark.createDataFrame([], STATE)
        return Budgets().advice(none)
    start = Budgets(*[head[name] for name in ("file_bytes", "table_bytes", "table_rows", "max_attempts")])
    waiting = ledger.every("steps", STEPS).filter(F.col("ts") > head["folded"])
    return start.advice(fold_stalls(waiting, start, ledger.read("state", head["state"], STATE)))
