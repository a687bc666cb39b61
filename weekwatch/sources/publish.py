"""Put a finished folder in the place of another, so that readers never meet half of it.

A folder is written aside, looked at, and renamed into place. The one that was there is kept beside it
until then, and comes back should the job end between the two renames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weekwatch.sources.scratch import remove
from weekwatch.sources.tables import path_exists, table_complete


def _beside(path: str, kind: str) -> str:
    """A hidden folder next to ``path``, passed over by whoever lists tables."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_{kind}/{name}"


def _rename(spark: SparkSession, old: str, new: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(new).getParent())
    if not fs.rename(path(old), path(new)):
        raise OSError(f"{old} could not be renamed to {new}")


def recover(spark: SparkSession, path: str) -> None:
    """Bring back the former folder where a job ended between taking it away and putting the new one there."""
    former = _beside(path, "former")
    if path_exists(spark, former):
        if path_exists(spark, path):
            remove(spark, former)
        else:
            _rename(spark, former, path)


def stage(df: DataFrame, path: str) -> str:
    """Write aside what is to come to ``path``; what an earlier job left there goes."""
    staged = _beside(path, "staged")
    df.write.mode("overwrite").parquet(staged)
    return staged


def discard(spark: SparkSession, path: str) -> None:
    """Forget what was staged for ``path``."""
    remove(spark, _beside(path, "staged"))


def publish(spark: SparkSession, path: str) -> None:
    """Put what was staged for ``path`` in its place.

    Each step is one rename, which is atomic on file systems with real renames; at any time the former
    folder or the new one is whole, and ``recover`` finds it. One job at a time may publish to a path.
    """
    staged, former = _beside(path, "staged"), _beside(path, "former")
    if not table_complete(spark, staged):
        raise ValueError(f"nothing whole is staged for {path}")
    recover(spark, path)
    if path_exists(spark, path):
        _rename(spark, path, former)
    _rename(spark, staged, path)
    remove(spark, former)
