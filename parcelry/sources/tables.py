"""Table reads, the catalogue, and structure-only definitions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelry.functions.literals import quoted_name
from parcelry.functions.scalars import to_integer

LOCATION = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"  # scheme and host in front of a path


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A whole table in definition order; any batch reader's format will do."""
    return spark.read.format(fmt).load(path)


def table_catalog(
    spark: SparkSession, paths: dict[str, str], estimates: dict[str, object] | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Name, rows and bytes per table.

    A positive estimate is trusted and costs no scan; otherwise the count is exact, which for
    Parquet reads the footers only. Bytes come from the file listing.
    """
    trusted = _trusted_estimates(spark, paths, estimates or {})
    counts = []
    for name, path in paths.items():
        label = F.lit(name).alias("name")
        if trusted.get(name, 0) > 0:
            rows = spark.range(1).select(F.lit(trusted[name]).cast("bigint").alias("rows"))
        else:
            rows = read_table(spark, path, fmt).agg(F.count("*").alias("rows"))
        counts.append(rows.select(label, "rows", F.lit(0).cast("bigint").alias("bytes")))
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths.values()))
    local = F.regexp_replace("path", LOCATION, "")
    owner = F.lit(None).cast("string")
    for name, path in paths.items():
        base = re.sub(LOCATION, "", path).rstrip("/")
        owner = F.when((local == base) | F.startswith(local, F.lit(base + "/")), name).otherwise(owner)
    sizes = listing.select(owner.alias("name"), F.lit(0).cast("bigint").alias("rows"), F.col("length").alias("bytes"))
    parts = reduce(DataFrame.unionByName, [*counts, sizes])
    return parts.groupBy("name").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def _trusted_estimates(spark: SparkSession, paths: dict[str, str], estimates: dict[str, object]) -> dict[str, int]:
    """Estimates as integers, unreadable ones as 0; one entry per listed table."""
    given = [(name, str(estimates[name])) for name in paths if estimates.get(name) is not None]
    if not given:
        return {}
    hints = spark.createDataFrame(given, "name string, hint string")
    return {row["name"]: row["rows"] for row in hints.select("name", to_integer(F.col("hint")).alias("rows")).collect()}


def type_text(data_type: T.DataType) -> str:
    """A type as its definition spells it: type names in upper case, names of nested fields as they are."""
    if isinstance(data_type, T.ArrayType):
        return f"ARRAY<{type_text(data_type.elementType)}>"
    if isinstance(data_type, T.MapType):
        return f"MAP<{type_text(data_type.keyType)},{type_text(data_type.valueType)}>"
    if isinstance(data_type, T.StructType):
        plain = lambda name: name if re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII) else quoted_name(name)
        return f"STRUCT<{','.join(f'{plain(f.name)}:{type_text(f.dataType)}' for f in data_type.fields)}>"
    return data_type.simpleString().upper()


def structure_text(table: str, schema: T.StructType) -> str:
    """The table's definition, framed so a reload drops and recreates it."""
    columns = ",\n".join(
        f"  {quoted_name(field.name)} {type_text(field.dataType)}{'' if field.nullable else ' NOT NULL'}" for field in schema.fields
    )
    name = quoted_name(table)
    return f"--\n-- Table structure for table {name}\n--\n\nDROP TABLE IF EXISTS {name};\nCREATE TABLE {name} (\n{columns}\n);\n"


def data_header(table: str) -> str:
    return f"\n--\n-- Dumping data for table {quoted_name(table)}\n--\n\n"


def structure_segments(tables: dict[str, DataFrame]) -> DataFrame:
    """One definition payload per structure-only table: metadata, no rows."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(i, name, structure_text(name, df.schema)) for i, (name, df) in enumerate(tables.items())]
    text = spark.createDataFrame(rows, "ordinal bigint, name string, payload string")
    return text.withColumn("payload", F.col("payload").cast("binary"))
