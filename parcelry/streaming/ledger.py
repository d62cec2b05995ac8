"""What a stream carries from one micro-batch to the next, as tables in a folder that every executor shares.

Each batch reads what the batch before it left and writes its own, so a batch that runs again after a crash starts from
the same rows and replaces what its first run wrote.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Ledger:
    """Carried tables below ``root``, by name and batch. Folder names begin with ``_``, so a sink may hold its ledger itself."""

    spark: SparkSession
    root: str

    def _path(self, name: str, batch_id: int) -> str:
        return f"{self.root.rstrip('/')}/_{name}/batch={batch_id}"

    def write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self._path(name, batch_id))

    def read(self, name: str, batch_id: int, schema: T.StructType) -> DataFrame:
        """What ``batch_id`` left; nothing if there was no such batch."""
        try:
            return self.spark.read.schema(schema).parquet(self._path(name, batch_id))
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise

    def every(self, name: str, schema: T.StructType) -> DataFrame:
        """What all batches left."""
        folder, dated = f"{self.root.rstrip('/')}/_{name}", T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        try:
            rows = self.spark.read.schema(dated).option("basePath", folder).parquet(f"{folder}/*")
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise
        return rows.select(*schema.fieldNames())

    def last(self, name: str) -> int:
        """The number of the last batch that left something; -1 before the first."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/_{name}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return -1
        found = [re.fullmatch(r"batch=(\d+)", status.getPath().getName()) for status in files.listStatus(folder)]
        return max((int(m[1]) for m in found if m), default=-1)
