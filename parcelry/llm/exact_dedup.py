"""Exact deduplication by a tree-merge of sorted digest runs.

Every task turns its rows into a run of digests. In each round, runs whose holders agree in all but one
digit of their number exchange: each of the ``FAN`` partners receives its share of the digest space from
the others and merges those runs, keeping one entry for each digest. After as many rounds as a holder's
number has digits, every digest lies with one holder. Equal digests meet pairwise at every level, so the
largest group of copies sends at most ``FAN`` entries to a holder in a round, whatever its size, and no
task ever holds more than its share.

An entry is kept as equal to another only if SHA-256, a second hash and the length all agree (verified at
every level); its identifier is the extreme one and its count the sum.

Results by case: a null text counts as empty; rows that repeat a ``doc_id`` and a text share one verdict;
a null ``doc_id`` is never kept beside a known one, and a group of null ids only keeps null; an empty table gives an
empty result; texts of any length are hashed where they are; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.llm.common import plain, shuffle_width, small, stage

#: Runs merged at once.
FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENTRY = ["sha", "check", "size"]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, check, size) of the text with A-Z lower-cased."""
    normal = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("t"))
    return normal.select("doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), F.xxhash64("t").alias("check"), F.octet_length("t").alias("size"))


def local_runs(rows: DataFrame) -> DataFrame:
    """Copies within a batch combined before anything is sent: (sha, check, size, keep_id, group_size, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = TaskContext.get().partitionId()
        for batch in batches:
            table = pa.Table.from_batches([batch.set_column(0, "keep_id", batch.column("doc_id"))])
            made = table.group_by(ENTRY, use_threads=False).aggregate([("keep_id", "min"), ("keep_id", "max"), ([], "count_all")])
            made = made.append_column("source", pa.array([source] * made.num_rows, pa.int64()))
            yield from made.rename_columns([*ENTRY, "least_id", "most_id", "group_size", "source"]).combine_chunks().to_batches()

    return rows.mapInArrow(run, "sha binary, check long, size int, least_id long, most_id long, group_size long, source long")


def merged_runs(rows: DataFrame, keep: str = "largest", fan: int = FAN, holders: int | None = None) -> DataFrame:
    """One entry for each digest: (sha, check, size, keep_id, group_size)."""
    largest = keep == "largest"
    known = F.col("keep_id").isNotNull() if largest else F.col("keep_id").isNull()
    # A struct has no fixed-width buffer, so the merge streams over sorted runs instead of hashing them.
    best = (F.max if largest else F.min)(F.struct(known.alias("known"), "keep_id"))
    wanted = holders or shuffle_width(rows.sparkSession)
    rounds = 1
    while fan**rounds < wanted:
        rounds += 1
    last = F.lit(fan**rounds)
    runs = local_runs(rows).select(*ENTRY, F.col("most_id" if largest else "least_id").alias("keep_id"), "group_size", F.pmod("source", last).alias("holder"))
    home = F.pmod(F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long"), last)
    for k in range(rounds):
        unit = fan**k
        digit = F.floor(home / unit) % fan
        own = F.floor(F.col("holder") / unit) % fan
        merged = (
            runs.withColumn("holder", (F.col("holder") + (digit - own) * unit).cast("int"))
            .repartitionById(fan**rounds, "holder")
            .sortWithinPartitions("holder", *ENTRY)
            .groupBy("holder", *ENTRY)
            .agg(best.alias("best"), F.sum("group_size").alias("group_size"))
        )
        runs = stage(merged.select(*ENTRY, F.col("best.keep_id").alias("keep_id"), "group_size", F.col("holder").cast("long").alias("holder")), f"dedup-round-{k}")
    return runs.drop("holder")


def exact_groups(docs: DataFrame, keep: str = "largest", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    rows = stage(digests(plain(docs, key, text)), "dedup-digests")
    merged = merged_runs(rows, keep)
    several = merged.where("group_size > 1")
    joined = rows.join(several, ENTRY, "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``docs`` less the rows whose text another row keeps; columns as they are. Rows with equal doc_id and text stay together."""
    groups = stage(exact_groups(docs, keep), "dedup-groups")
    dropped = groups.where("NOT kept").select("doc_id", "text_sha256").distinct().toDF("_gone", "_sha")
    normal = F.sha2(F.translate(F.coalesce(docs["text"], F.lit("")), UPPER, LOWER), 256)
    gone = small(dropped)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (normal == gone["_sha"]), "left_anti")
