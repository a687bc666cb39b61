"""Streaming forms: row checks need no state; the rest is bounded by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weekwatch.operators.checks import add_flags
from weekwatch.operators.cleaning import clamp_hosp_gt_cases, flag_deaths_gt_hosp
from weekwatch.sources.tables import is_file
from weekwatch.specs import TableSpec

#: Offset of the first Monday after the epoch, so that weeks start on Mondays.
MONDAY_OFFSET = "4 days"
SECONDS_PER_DAY = 86_400
POLL_SECONDS = 1


class LateRowsError(ValueError):
    """Rows came too late and would be missing from the result."""


def read_files(
    spark: SparkSession, folder: str, schema: T.StructType | str, **options
) -> DataFrame:
    """New Parquet files in a folder as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """A Parquet table as a stream, be it a folder of files or a single file."""
    if not is_file(spark, path):
        return read_files(spark, path, schema, **options)
    folder, _, name = path.rpartition("/")
    return read_files(spark, folder, schema, pathGlobFilter=name, **options)


def utc_instant(name: str) -> Column:
    """A time without zone as the instant at which clocks in UTC show it; watermarks need instants."""
    return F.from_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone())


def check_rows(stream: DataFrame, spec: TableSpec) -> DataFrame:
    """All row checks and audit flags; the very expressions used on stored tables."""
    checked = flag_deaths_gt_hosp(add_flags(stream, spec), spec.hosp.total, spec.deaths.total)
    return clamp_hosp_gt_cases(checked, spec.cases_col, spec.hosp.total)


def drop_repeats(
    stream: DataFrame, key_cols: Sequence[str], time_col: str, delay: str
) -> DataFrame:
    """The first row of each key among rows at most ``delay`` apart; older keys are forgotten."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(key_cols))


def weekly_counts(
    stream: DataFrame, group_keys: Sequence[str], time_col: str, delay: str
) -> DataFrame:
    """``group, week_start, n``: rows per group and Monday week, closed ``delay`` after its end.

    Weeks start on Mondays at midnight in UTC, whatever the session's time zone.
    """
    week = F.window(time_col, "7 days", "7 days", MONDAY_OFFSET)
    counted = (
        stream.withWatermark(time_col, delay)
        .groupBy(week.alias("week"), *group_keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    days = F.floor(F.unix_seconds("week.start") / SECONDS_PER_DAY).cast("int")
    return counted.select(*group_keys, F.date_from_unix_date(days).alias("week_start"), "n")


def run_available(
    stream: DataFrame, out_dir: str, checkpoint_dir: str, fail_on_late: bool = False
) -> int:
    """Process what is there now, exactly once, into Parquet; the next call goes on from here.

    Returns how many rows came too late for the watermark, over all batches; with
    ``fail_on_late`` any such row is an error. Lateness shows in the order of arrival,
    so it can only come up between batches: rows read together are never late.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    return finish(query, fail_on_late)


def finish(query: StreamingQuery, fail_on_late: bool = False) -> int:
    """Wait for a query that ends by itself; how many rows it passed over as too late."""
    late: dict[int, int] = {}
    ended = False
    while not ended:
        # Spark keeps the progress of the last batches only, so it is read as they go.
        ended = query.awaitTermination(timeout=POLL_SECONDS)
        for progress in query.recentProgress:
            late[progress.batchId] = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
    dropped = sum(late.values())
    if dropped and fail_on_late:
        raise LateRowsError(f"{dropped} rows came later than the watermark allows")
    return dropped
