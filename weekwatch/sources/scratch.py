"""Intermediate tables in the folder that the executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where it names none, a folder in its warehouse.

    Both are shared by the driver and all executors on any master.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    return named.rstrip("/") if named else f"{spark.conf.get(WAREHOUSE_CONF).rstrip('/')}/_scratch"


def store(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write the table once and return it as read back.

    Used where several jobs or branches read the same small result: the input is
    scanned once, and a lost executor costs a read of this table, not a new scan.
    """
    spark = df.sparkSession
    path = f"{folder or scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system the path names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for one job's intermediate tables, removed when the job ends."""
    path = f"{scratch_dir(spark)}/job-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)
