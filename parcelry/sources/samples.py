"""Progress-sample series as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_SCHEMA = (
    "epoch bigint, iso string, state string, tables_done bigint, tables_total bigint, "
    "files_done bigint, files_total bigint, chunks_done bigint, http string"
)


def read_samples(spark: SparkSession, path: str, series: str | None = None) -> DataFrame:
    """Samples of one or many series; without a name the series is the file's folder or stem."""
    rows = spark.read.schema(SAMPLE_SCHEMA).option("header", "true").option("recursiveFileLookup", "true").csv(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1)
    name = F.lit(series) if series else stem
    return rows.withColumn("series", name).withColumn("sample_id", F.monotonically_increasing_id())
