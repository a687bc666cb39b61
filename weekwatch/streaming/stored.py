"""Streams that keep stored results up to date: series with their flags, and deduplicated tables.

Every batch is written under its number, so one that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekwatch.functions.ordered import same
from weekwatch.sources.upsert import UpsertTable
from weekwatch.streaming.weekly import finish

Detect = Callable[[DataFrame], DataFrame]


class LiveSeries:
    """A series per group and date under ``path``, added to by batches, with flags that follow it.

    ``sums`` are columns that add up, such as counts. A batch adds its own sums; the series is their total,
    so rows may come in any order and as late as they like. Flags are found anew for the groups that a batch
    touches, on their whole series, which is as long as the calendar.
    """

    def __init__(
        self, spark: SparkSession, path: str, group_schema: str, date_col: str, sums: Sequence[str], detect: Detect, flag_schema: str
    ):
        self.spark, self.date_col, self.sums, self.detect = spark, date_col, list(sums), detect
        groups = T._parse_datatype_string(group_schema)
        self.group_keys = groups.names
        parts = T.StructType([*groups.fields, T.StructField(date_col, T.DateType()), *(T.StructField(s, T.LongType()) for s in sums)])
        self.parts = UpsertTable(spark, f"{path}/parts", parts, [*self.group_keys, date_col])
        self.flagged = UpsertTable(spark, f"{path}/flags", T._parse_datatype_string(flag_schema), self.group_keys)

    def series(self) -> DataFrame:
        """One row per group and date."""
        return self.parts.rows().groupBy(*self.group_keys, self.date_col).agg(*(F.sum(s).alias(s) for s in self.sums))

    def flags(self) -> DataFrame:
        """What ``detect`` gives on the whole series, of every group."""
        return self.flagged.latest()

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take in a batch of rows that have the group, the date, and what is to be added up."""
        if batch <= self.parts.compacted():
            return
        summed = rows.groupBy(*self.group_keys, self.date_col).agg(*(F.sum(s).cast("bigint").alias(s) for s in self.sums))
        self.parts.put(summed, batch)
        names = [f"__{k}" for k in self.group_keys]
        mine = self.parts.rows().where(F.col("batch") == batch)
        touched = mine.select(*(F.col(k).alias(n) for k, n in zip(self.group_keys, names, strict=True))).distinct()
        again = self.series().join(touched, same(self.group_keys, names), "left_semi")
        self.flagged.put(self.detect(again), batch)

    def compact(self) -> None:
        """Add up the batches, and keep of the flags those that count. Not while a stream runs."""
        self.flagged.compact()
        self.parts.compact(self.series())


def keep_up(stream: DataFrame, add: Callable[[DataFrame, int], None], checkpoint_dir: str, mode: str = "append", fail_on_late: bool = False) -> int:
    """Hand every batch of what is there now to ``add``, with its number; the next call goes on from here.

    Returns how many rows came too late, as ``run_available`` does. A batch whose ``add`` did not come to an end
    comes again under the same number.
    """
    query = (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    return finish(query, fail_on_late)


def deduplicate_stream(
    stream: DataFrame,
    key: Sequence[str],
    metrics: Sequence[str],
    passthrough: Sequence[str],
    tie_break: str | None,
    date_col: str,
    delay: str,
) -> DataFrame:
    """The streaming form of ``cleaning.deduplicate``, for update mode into an ``UpsertTable`` by ``key``.

    The largest value of each metric and one row's pass-through values are kept as state per key, and a key comes
    out again whenever a row changes it. ``date_col`` is part of the key: keys more than ``delay`` behind the latest
    date are forgotten, and rows for them are late. A row without a date has no place in the stream's time and
    never comes out; it is not counted as late.
    """
    order = dict.fromkeys([tie_break, *passthrough] if tie_break else passthrough)
    values = [part for i, c in enumerate(order) for part in (F.isnull(c).alias(f"n{i}"), F.col(c).alias(f"v{i}"))]
    dated = stream.withColumn("__time", F.col(date_col).cast("timestamp")).withWatermark("__time", delay)
    largest = [F.max(m).alias(m) for m in metrics]
    kept = [F.min(F.struct(*values)).alias("__kept")] if values else []
    grouped = dated.groupBy("__time", *key).agg(*largest, *kept)
    at = {c: i for i, c in enumerate(order)}
    picked: list[Column] = [F.col(f"__kept.v{at[c]}").alias(c) for c in passthrough]
    return grouped.select(*key, *metrics, *picked)
