"""A folder of Parquet tables as a snapshot source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUFFIX = ".parquet"


class ParquetSource:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def tables(self) -> list[str]:
        """Names of the Parquet files and folders directly inside the folder."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [entry.getPath().getName() for entry in fs.listStatus(path)]
        return sorted(n.removesuffix(SUFFIX) for n in names if n.endswith(SUFFIX))

    def count(self, table: str) -> int:
        """Rows by the footers."""
        return self._table(table).count()

    def read(self, table: str) -> DataFrame:
        return self._table(table)

    def _table(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}{SUFFIX}")
