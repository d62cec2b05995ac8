"""The audit log: JSON lines in one folder per UTC day."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_login", T.StringType()),
        T.StructField("api_version", T.IntegerType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("tables", T.ArrayType(T.StringType())),
        T.StructField("tables_structure_only", T.ArrayType(T.StringType())),
        T.StructField(
            "files",
            T.StructType(
                [
                    T.StructField("count", T.LongType()),
                    T.StructField("bytes", T.LongType()),
                    T.StructField("roots", T.ArrayType(T.StringType())),
                    T.StructField("sha256", T.StringType()),
                ]
            ),
        ),
    ]
)
CORRUPT = "_corrupt_record"


def utc_day(ts: Column) -> Column:
    return F.to_date(F.timestamp_seconds(ts))


def append_audit(entries: DataFrame, path: str) -> None:
    """Appends entries, JSON lines partitioned by day; the committer makes the append whole."""
    known = [name for name in AUDIT_SCHEMA.fieldNames() if name in entries.columns]
    dated = entries.select(*known).withColumn("day", utc_day(F.col("ts")))
    # One shuffle gathers each day's lines, a salt keeps a busy day in several files.
    salted = dated.withColumn("_salt", F.pmod(F.xxhash64("job_id", "seq"), F.lit(16)))
    salted.repartition("day", "_salt").drop("_salt").write.mode("append").partitionBy("day").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the log; a line that is not a well-typed object is dropped."""
    schema = T.StructType([*AUDIT_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    dated = T.StructType([*schema.fields, T.StructField("day", T.DateType())])
    lines = spark.read.schema(dated).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return lines.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


ROTATION = "_rotation"  # readers pass over names that begin with ``_``


def rotate_audit(spark: SparkSession, path: str, now: int, days: int = 90) -> None:
    """Takes entries out of the stored log that are older than the window, or have no readable time.

    Folders of older days go whole. Only the day the window begins in is rewritten, and only if it holds something
    older: what stays of the files found there is written aside, a list of these files commits it, and then it takes
    their place. Files appended meanwhile are not touched, and a rotation that died is ended by the next. An emptied log's
    folder goes too.
    """
    log = _folder(spark, path)
    files = log.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(log):
        return
    _end_rotations(spark, files, path)
    cutoff = now - max(0, days) * 86400
    edge = spark.range(1).select(utc_day(F.lit(cutoff)).cast("string")).first()[0]
    for status in files.listStatus(log):
        name = status.getPath().getName()
        if name.startswith("day=") and (name[4:] < edge or name[4:].startswith("__")):
            files.delete(status.getPath(), True)
    day = _folder(spark, f"{path}/day={edge}")
    if files.exists(day):
        found = [f.getPath().toString() for f in files.listStatus(day) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
        lines = spark.read.text(found).select("value") if found else None
        in_window = F.from_json("value", "ts bigint")["ts"] > cutoff
        if lines is not None and not lines.filter(~F.coalesce(in_window, F.lit(False))).isEmpty():
            aside = f"{path}/{ROTATION}/day={edge}/{uuid.uuid4().hex}"
            lines.filter(in_window).write.text(aside)
            spark.createDataFrame([(name,) for name in found], "value string").coalesce(1).write.text(f"{aside}/_replaced")
            _end_rotations(spark, files, path)
    if not any(s.getPath().getName().startswith("day=") for s in files.listStatus(log)):
        files.delete(log, True)


def _folder(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _end_rotations(spark: SparkSession, files, path: str) -> None:
    """Puts committed rewrites in place and drops the others; every step may be repeated."""
    root = _folder(spark, f"{path}/{ROTATION}")
    if not files.exists(root):
        return
    for day in files.listStatus(root):
        target = f"{path}/{day.getPath().getName()}"
        for aside in files.listStatus(day.getPath()):
            replaced = f"{aside.getPath().toString()}/_replaced"
            if files.exists(_folder(spark, f"{replaced}/_SUCCESS")):
                for row in spark.read.text(replaced).collect():  # the files of one day
                    files.delete(_folder(spark, row["value"]), False)
                for part in files.listStatus(aside.getPath()):
                    name = part.getPath().getName()
                    if name.startswith("part-") and part.getLen():
                        files.rename(part.getPath(), _folder(spark, f"{target}/{name}"))
    files.delete(root, True)
    for status in files.listStatus(_folder(spark, path)):
        if status.getPath().getName().startswith("day=") and not files.listStatus(status.getPath()):
            files.delete(status.getPath(), False)
