"""Copy the tables of a source to Parquet, one folder per table."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weekwatch.sources.publish import discard, publish, recover, stage
from weekwatch.sources.tables import table_complete

STATUS_SCHEMA = T.StructType(
    [
        T.StructField("table", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("rows", T.LongType()),
        T.StructField("source_rows", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("rows_per_second", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)


class Source(Protocol):
    """Anything that can list its tables, hand one over as a DataFrame, and count its rows."""

    def tables(self) -> list[str]: ...

    def read(self, table: str) -> DataFrame: ...

    def count(self, table: str) -> int: ...


def _copy(
    spark: SparkSession, source: Source, table: str, out_dir: str, force: bool
) -> tuple[str, str, int | None, int | None, float | None, float | None, str | None]:
    path = f"{out_dir}/{table}.parquet"
    start = time.perf_counter()
    try:
        recover(spark, path)
        if not force and table_complete(spark, path):
            return table, "skipped", None, None, None, None, None
        expected = source.count(table)
        # Counted from the footers of what was written.
        rows = spark.read.parquet(stage(source.read(table), path)).count()
        if rows == expected:
            publish(spark, path)
        seconds = time.perf_counter() - start
        wrong = None if rows == expected else f"{rows} rows written, {expected} in the source"
        return table, "error" if wrong else "written", rows, expected, seconds, rows / seconds, wrong
    except Exception as error:  # one bad table must not stop the others
        seconds = time.perf_counter() - start
        return table, "error", None, None, seconds, None, f"{type(error).__name__}: {error}"
    finally:
        discard(spark, path)


def snapshot_tables(
    spark: SparkSession,
    source: Source,
    out_dir: str,
    tables: Sequence[str] | None = None,
    force: bool = False,
    jobs: int = 4,
) -> DataFrame:
    """Copy whole tables to ``<out_dir>/<table>.parquet`` and report on each.

    Columns: ``table, status, rows`` written, ``source_rows`` counted there before,
    ``seconds, rows_per_second, error``. A copy is written aside, counted, and put in its place
    only if it has as many rows as the source; else it is an error, and what was there before, if
    anything, is there still. A table that is already there is skipped unless ``force``. A failing
    table is reported and the rest go on. Tables are independent jobs, ``jobs`` of them at a time.
    """
    names = list(source.tables() if tables is None else tables)
    with ThreadPoolExecutor(max_workers=max(1, jobs)) as pool:
        done = list(pool.map(lambda t: _copy(spark, source, t, out_dir, force), names))
    return spark.createDataFrame(done, STATUS_SCHEMA)
