"""Budget advice from an attempt journal: what bounds a job should use after its stalls.

An attempt begun when two earlier ones since the last advance (or halving) bore no fruit
halves the bounds it spends: one for a file, two for a table. A structure or index attempt
spends none, so its stall fails the job, as does a stall with every spent bound at 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.operators.ordered import HOT_ROWS, find_hot, running_sum_in_group

# The bounds a job starts from.
FILE_BYTES, TABLE_BYTES, TABLE_ROWS = 256 * 1024, 4 * 1024 * 1024, 1000


def halvings_to_floor(bound: int) -> int:
    """How often a bound can be halved before it is 1."""
    return max(1, bound).bit_length() - 1


#: Before every step of a journal.
EARLIEST = -(1 << 63)


@dataclass(frozen=True)
class Budgets:
    """The bounds a job starts from, and the attempts it may make without an advance."""

    file_bytes: int = FILE_BYTES
    table_bytes: int = TABLE_BYTES
    table_rows: int = TABLE_ROWS
    max_attempts: int = 2

    def advice(self, folded: DataFrame) -> DataFrame:
        """Bounds per job from its halvings."""
        halved = lambda bound, times: F.greatest(F.lit(1), F.floor(F.lit(bound) / F.pow(F.lit(2), times))).cast("bigint")
        return folded.select(
            "job_id",
            halved(self.file_bytes, F.col("files")).alias("file_bytes"),
            halved(self.table_bytes, F.col("tables")).alias("table_bytes"),
            halved(self.table_rows, F.col("tables")).alias("table_rows"),
            "failed",
        )


def stall_budgets(
    events: DataFrame,
    file_bytes: int = FILE_BYTES,
    table_bytes: int = TABLE_BYTES,
    table_rows: int = TABLE_ROWS,
    max_attempts: int = 2,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Bounds per job at the end of its journal, without replaying it row by row.

    ``events`` has ``kind`` ``attempt`` or ``advance`` and, for attempts, ``spends``.
    """
    start = Budgets(file_bytes, table_bytes, table_rows, max_attempts)
    return start.advice(fold_stalls(events, start, hot_rows=hot_rows))


def fold_stalls(events: DataFrame, start: Budgets, carried: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(job_id, files, tables, failed): how often each job's file and table bounds are halved, and whether it failed.

    In a run of attempts every ``max_attempts``-th one after the first finds the counter spent, so the halvings are a
    count, and the job fails at the first stall past the floor.

    ``carried`` is what a fold of earlier steps gave, with ``fruitless``, the attempts left on each job's counter; the
    result then has that column too. Attempts on the counter, and halvings done, go before the steps as rows of their own,
    so a hot job's continued fold is split like any other.
    """
    job, order = ["job_id"], ["ts", "event_id"]
    columns = ["job_id", "ts", "event_id", "kind", "spends"]
    steps = events.select(*columns)
    if carried is not None:
        left = carried.filter("fruitless > 0").select("job_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("fruitless").cast("bigint"))).alias("event_id"))
        before = left.select("job_id", F.lit(EARLIEST).alias("ts"), "event_id", F.lit("attempt").alias("kind"), F.lit(None).cast("string").alias("spends"))
        steps = before.unionByName(steps)
    is_attempt = F.col("kind") == "attempt"
    advance = (F.col("kind") == "advance").cast("bigint")
    heat = find_hot(steps, job, hot_rows)
    runs = running_sum_in_group(steps, job, order, {"run": advance, "attempts": is_attempt.cast("bigint")}, heat)
    first = runs.groupBy("job_id", "run").agg(F.min(F.when(is_attempt, F.col("attempts"))).alias("first_attempt"))
    placed = runs.filter(is_attempt).join(first, ["job_id", "run"])
    nth, limit = F.col("attempts") - F.col("first_attempt") + 1, start.max_attempts
    stalls = placed.filter((nth > limit) & ((nth - 1) % limit == 0))
    spends = F.col("spends")
    one = lambda holds: holds.cast("bigint")
    counted = stalls.select(
        "job_id", "ts", "event_id", one(spends == "file").alias("f"), one(spends == "table").alias("t"), one(~spends.isin("file", "table")).alias("r")
    )
    if carried is not None:
        # A failed job's halvings stand, and whatever follows comes after its failure.
        nothing = F.lit(0).cast("bigint")
        done = carried.select("job_id", F.lit(EARLIEST).alias("ts"), nothing.alias("event_id"), F.col("files").alias("f"), F.col("tables").alias("t"), nothing.alias("r"))
        over = carried.filter("failed").select(
            "job_id", F.lit(EARLIEST).alias("ts"), F.lit(1).cast("bigint").alias("event_id"), nothing.alias("f"), nothing.alias("t"), F.lit(1).cast("bigint").alias("r")
        )
        counted = counted.unionByName(done).unionByName(over)
    summed = running_sum_in_group(counted, job, order, {"files": F.col("f"), "tables": F.col("t"), "rigid": F.col("r")}, heat)
    table_room = max(halvings_to_floor(start.table_bytes), halvings_to_floor(start.table_rows))
    broken = (F.col("files") > halvings_to_floor(start.file_bytes)) | (F.col("tables") > table_room) | (F.col("rigid") > 0)
    outcome = summed.groupBy("job_id").agg(
        F.max(F.when(~broken, F.col("files"))).alias("files"),
        F.max(F.when(~broken, F.col("tables"))).alias("tables"),
        F.max(broken).alias("failed"),
    )
    jobs = events.select("job_id").distinct()
    if carried is not None:
        ends = runs.groupBy("job_id", "run").agg(F.count_if(is_attempt).alias("n")).groupBy("job_id").agg(F.max_by("n", "run").alias("n"))
        counter = F.when(F.coalesce("n", F.lit(0)) > 0, (F.col("n") - 1) % limit + 1).otherwise(0).cast("int")
        known = events.select("job_id").unionByName(carried.select("job_id")).distinct()
        jobs = known.join(ends, "job_id", "left").select("job_id", counter.alias("fruitless"))
    joined = jobs.join(outcome, "job_id", "left")
    found = {"files": F.coalesce("files", F.lit(0)), "tables": F.coalesce("tables", F.lit(0)), "failed": F.coalesce("failed", F.lit(False))}
    return joined.withColumns(found)
