"""A table that streams write in batches, each of which may be written again.

A batch is a folder of its own, so a batch that is repeated after a failure replaces itself. Rows of a
key in a later batch stand for those of earlier ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekwatch.sources.publish import publish, stage
from weekwatch.sources.scratch import remove
from weekwatch.sources.tables import path_exists

BATCH = "batch"


class UpsertTable:
    """Batches of rows under ``path``; ``keys`` are what a later batch replaces, all rows of a key together.

    Compacted rows lie beside the batches, under the number of the last one that they hold; batches up to it
    are not read, and if they come again, are not written.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)

    def _read(self, part: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType())])
        if not path_exists(self.spark, f"{self.path}/{part}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def _write(self, rows: DataFrame, part: str, batch: int) -> None:
        folder = f"{self.path}/{part}/{BATCH}={batch}"
        stage(rows.select(*self.schema.names), folder)
        publish(self.spark, folder)

    def _newest(self, part: str) -> int:
        found = self._read(part).agg(F.max(BATCH)).first()[0]
        return -1 if found is None else found

    def compacted(self) -> int:
        """The number of the last batch that the compacted rows hold, -1 where there are none."""
        return self._newest("base")

    def put(self, rows: DataFrame, batch: int) -> None:
        """Store a batch; the same batch written before is replaced, whole or not at all."""
        if batch > self.compacted():
            self._write(rows, "batches", batch)

    def rows(self) -> DataFrame:
        """All rows that are kept, with their ``batch``."""
        upto = self.compacted()
        base = self._read("base").where(F.col(BATCH) == upto)
        return base.union(self._read("batches").where(F.col(BATCH) > upto))

    def latest(self) -> DataFrame:
        """Of each key the rows of the last batch that has it."""
        newest = F.max(BATCH).over(Window.partitionBy(*self.keys))
        return self.rows().withColumn("__newest", newest).where(F.col(BATCH) == F.col("__newest")).drop(BATCH, "__newest")

    def compact(self, rows: DataFrame | None = None) -> None:
        """Put ``rows``, those that count unless given, in the place of all batches. Not while a stream writes.

        Batches go only after the compacted rows are there.
        """
        newest = self._newest("batches")
        if newest > self.compacted():
            self._write(self.latest() if rows is None else rows, "base", newest)
        for part, last in (("batches", newest), ("base", newest - 1)):
            for row in self._read(part).where(F.col(BATCH) <= last).select(BATCH).distinct().collect():
                remove(self.spark, f"{self.path}/{part}/{BATCH}={row[0]}")
