"""The detectors on raw rows: groups of any length, however unequal.

Series of weeks are as short as the calendar and go through windows (``operators.outliers``). Here a group
may hold a third of all rows. Quartiles, medians and deviations come from counts of values, which are added
up before they are shuffled, and from ranks over ranges; rolling frames from buckets of rows that overlap.
No task meets a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekwatch.functions import safe_div
from weekwatch.functions.ordered import attach, rank_quantiles, running, value_counts
from weekwatch.operators.outliers import (
    IQR_K,
    MAD_THRESHOLD,
    NORMAL_CONSISTENCY,
    ROLLING_THRESHOLD,
    ROLLING_WINDOW,
    SEASONAL_THRESHOLD,
    rolling_frame,
)
from weekwatch.sources.scratch import store

#: A bucket of a rolling frame holds so many rows, besides the few that it shares with its neighbours.
BUCKET_ROWS = 100_000


def _wide(per_metric: DataFrame, keys: Sequence[str], metrics: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per group from one row per group and metric: ``<name>_<metric>``."""
    picked = [F.max(F.when(F.col("metric") == m, F.col(n))).alias(f"{n}_{m}") for m in metrics for n in names]
    return per_metric.groupBy(*keys).agg(*picked)


def flag_iqr(
    df: DataFrame, group_keys: Sequence[str], metrics: Sequence[str], k: float = IQR_K, interpolation: str = "nearest"
) -> DataFrame:
    """The columns of ``outliers.flag_iqr``, on rows in any number.

    A null value is in no quartile and its flag is null, as are those of a group without values.
    """
    keys = list(group_keys)
    quartiles = rank_quantiles(value_counts(df, keys, metrics), [*keys, "metric"], {"__q1": 0.25, "__q3": 0.75}, interpolation)
    wide = store(_wide(quartiles, keys, metrics, ["__q1", "__q3"]), "quartiles")
    added = {}
    for m in metrics:
        q1, q3 = F.col(f"__q1_{m}"), F.col(f"__q3_{m}")
        low, high = q1 - (q3 - q1) * F.lit(float(k)), q3 + (q3 - q1) * F.lit(float(k))
        added |= {f"{m}__iqr_low": low, f"{m}__iqr_high": high, f"{m}__is_iqr": (F.col(m) < low) | (F.col(m) > high)}
    return attach(df, wide, keys).withColumns(added).drop(*(f"__q{i}_{m}" for i in (1, 3) for m in metrics))


def _flag_robust(
    df: DataFrame, keys: list[str], metrics: Sequence[str], score: str, flag: str, threshold: float
) -> DataFrame:
    """0.6745 (x - median) / MAD, in two rounds of ranks over the same counts."""
    by = [*keys, "metric"]
    counts = store(value_counts(df, keys, metrics), "counts")
    medians = store(rank_quantiles(counts, by, {"__median": 0.5}, "linear"), "medians")
    off = attach(counts, medians, by).withColumn("value", F.abs(F.col("value") - F.col("__median")))
    # Values equally far above and below the median are one deviation.
    off = off.groupBy(*by, "value").agg(F.sum("n").alias("n"))
    spreads = rank_quantiles(off, by, {"__spread": 0.5}, "linear")
    wide = store(_wide(attach(medians, spreads, by), keys, metrics, ["__median", "__spread"]), "spreads")
    scores = {
        f"{m}{score}": safe_div((F.col(m) - F.col(f"__median_{m}")) * F.lit(NORMAL_CONSISTENCY), F.col(f"__spread_{m}"))
        for m in metrics
    }
    flags = {f"{m}{flag}": F.abs(F.col(f"{m}{score}")) > F.lit(float(threshold)) for m in metrics}
    spent = [f"__{part}_{m}" for part in ("median", "spread") for m in metrics]
    return attach(df, wide, keys).withColumns(scores).withColumns(flags).drop(*spent)


def flag_mad(df: DataFrame, group_keys: Sequence[str], metrics: Sequence[str], threshold: float = MAD_THRESHOLD) -> DataFrame:
    """The columns of ``outliers.flag_mad``, on rows in any number."""
    return _flag_robust(df, list(group_keys), metrics, "__mad_score", "__is_mad", threshold)


def flag_seasonal(
    df: DataFrame, group_keys: Sequence[str], metrics: Sequence[str], season_col: str, threshold: float = SEASONAL_THRESHOLD
) -> DataFrame:
    """The columns of ``outliers.flag_seasonal``, on rows in any number."""
    return _flag_robust(df, [*group_keys, season_col], metrics, "__seas_score", "__is_seas", threshold)


def _buckets(window: int, size: int) -> Column:
    """The buckets in which a row is wanted: its own, and a neighbour's where a frame there reaches it."""
    first, last = rolling_frame(window)
    place = F.col("__upto") - 1
    own, inside = F.floor(place / size), place % size
    # A frame reaches ``-first`` rows back and ``last`` ahead.
    after = F.when(inside >= size + first, own + 1)
    before = F.when((inside < last) & (own > 0), own - 1)
    return F.array_compact(F.array(own, after, before))


def flag_rolling_z(
    df: DataFrame,
    group_keys: Sequence[str],
    metrics: Sequence[str],
    order: Sequence[str],
    window: int = ROLLING_WINDOW,
    threshold: float = ROLLING_THRESHOLD,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The columns of ``outliers.flag_rolling_z``, on groups of any number of rows.

    ``order`` should tell the rows of a group apart. A group is cut into buckets of consecutive rows; rows near
    the end of a bucket are copied to the next, and those near its beginning to the one before.
    """
    keys, size = list(group_keys), max(bucket_rows, window)
    placed = running(df, keys, order)
    dealt = placed.withColumn("__bucket", F.explode(_buckets(window, size)))
    frame = Window.partitionBy(*keys, "__bucket").orderBy("__upto").rowsBetween(*rolling_frame(window))
    scores = {}
    for m in metrics:
        z = safe_div(F.col(m) - F.avg(m).over(frame), F.stddev_samp(m).over(frame))
        scores[f"{m}__roll_z"] = F.when(F.count(m).over(frame) >= max(3, window // 2), z)
    own = F.floor((F.col("__upto") - 1) / size) == F.col("__bucket")
    scored = dealt.withColumns(scores).where(own).drop("__bucket", "__upto", "__total")
    return scored.withColumns({f"{m}__is_roll": F.abs(F.col(f"{m}__roll_z")) > F.lit(float(threshold)) for m in metrics})
