"""Weekly series and the four univariate detectors.

``weekly_series`` aggregates before it shuffles and leaves one row per group
and date, so the longest series has as many rows as the calendar has dates (a
century of weeks is 5,218) even if one region holds most of the raw rows. The
detectors work on such series. They are all window expressions over the same
partitioning: the series is shuffled once by group, and quartiles, medians,
rolling and seasonal statistics of every metric are found behind that one
exchange, without reading the input again and without joining back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekwatch.functions import group_median, group_quantiles, safe_div

# The usual thresholds of the detectors.
IQR_K = 1.5
MAD_THRESHOLD = 3.5
ROLLING_WINDOW = 13
ROLLING_THRESHOLD = 3.0
SEASONAL_THRESHOLD = 3.5
NORMAL_CONSISTENCY = 0.6745

METHODS = ("iqr", "mad", "roll", "seas")


def weekly_series(
    df: DataFrame,
    group_keys: Sequence[str],
    date_col: str,
    metrics: Sequence[str],
    carried: Sequence[str] = (),
) -> DataFrame:
    """One row per group and date, with the largest value of every other column.

    The time column is reduced to its date, which is what bounds the series.
    """
    largest = [F.max(c).alias(c) for c in (*metrics, *carried)]
    return df.groupBy(*group_keys, F.to_date(date_col).alias(date_col)).agg(*largest)


def _listed(metrics: str | Sequence[str]) -> list[str]:
    return [metrics] if isinstance(metrics, str) else list(metrics)


def _beyond(score: str, threshold: float) -> Column:
    return F.abs(F.col(score)) > F.lit(float(threshold))


def flag_iqr(
    df: DataFrame,
    group_keys: Sequence[str],
    metrics: str | Sequence[str],
    k: float = IQR_K,
    interpolation: str = "nearest",
) -> DataFrame:
    """Tukey's fences around the quartiles of the group, a series as ``weekly_series`` makes it."""
    metrics = _listed(metrics)
    quartiles = group_quantiles(
        df, group_keys, metrics, {"__q1_": 0.25, "__q3_": 0.75}, interpolation
    )
    added = {}
    for m in metrics:
        q1, q3 = F.col(f"__q1_{m}"), F.col(f"__q3_{m}")
        low, high = q1 - (q3 - q1) * F.lit(float(k)), q3 + (q3 - q1) * F.lit(float(k))
        added[f"{m}__iqr_low"], added[f"{m}__iqr_high"] = low, high
        added[f"{m}__is_iqr"] = (F.col(m) < low) | (F.col(m) > high)
    spent = [f"__q{i}_{m}" for i in (1, 3) for m in metrics]
    return quartiles.withColumns(added).drop(*spent)


def _flag_robust(
    df: DataFrame,
    keys: Sequence[str],
    metrics: str | Sequence[str],
    score: str,
    flag: str,
    threshold: float,
) -> DataFrame:
    """0.6745 (x - median) / MAD over the keys; null where the MAD is zero."""
    metrics = _listed(metrics)
    off = {m: F.col(m) - F.col(f"__median_{m}") for m in metrics}
    scores = {
        f"{m}{score}": safe_div(off[m] * F.lit(NORMAL_CONSISTENCY), F.col(f"__spread_{m}"))
        for m in metrics
    }
    return (
        df.withColumns({f"__median_{m}": group_median(m, keys) for m in metrics})
        .withColumns({f"__spread_{m}": group_median(F.abs(off[m]), keys) for m in metrics})
        .withColumns(scores)
        .withColumns({f"{m}{flag}": _beyond(f"{m}{score}", threshold) for m in metrics})
        .drop(*(f"__{part}_{m}" for part in ("median", "spread") for m in metrics))
    )


def flag_mad(
    df: DataFrame,
    group_keys: Sequence[str],
    metrics: str | Sequence[str],
    threshold: float = MAD_THRESHOLD,
) -> DataFrame:
    """Modified z-score against the whole series, as ``weekly_series`` makes it."""
    return _flag_robust(df, group_keys, metrics, "__mad_score", "__is_mad", threshold)


def flag_seasonal(
    df: DataFrame,
    group_keys: Sequence[str],
    metrics: str | Sequence[str],
    season_col: str = "semana",
    threshold: float = SEASONAL_THRESHOLD,
) -> DataFrame:
    """Modified z-score against the same week of other years, in a series of ``weekly_series``."""
    keys = [*group_keys, season_col]
    return _flag_robust(df, keys, metrics, "__seas_score", "__is_seas", threshold)


def rolling_frame(window: int) -> tuple[int, int]:
    """Offsets of a centred frame of ``window`` rows; even widths lean back."""
    ahead = (window + 1) // 2 - 1
    return ahead + 1 - window, ahead


def flag_rolling_z(
    df: DataFrame,
    group_keys: Sequence[str],
    metrics: str | Sequence[str],
    date_col: str = "week_start",
    window: int = ROLLING_WINDOW,
    threshold: float = ROLLING_THRESHOLD,
) -> DataFrame:
    """z-score against a centred frame of rows of a series; missing weeks are not filled in.

    Null when the frame has fewer than ``max(3, window // 2)`` values or no spread.
    """
    metrics = _listed(metrics)
    frame = Window.partitionBy(*group_keys).orderBy(date_col).rowsBetween(*rolling_frame(window))
    scores = {}
    for m in metrics:
        enough = F.count(m).over(frame) >= max(3, window // 2)
        off = F.col(m) - F.avg(m).over(frame)
        z = safe_div(off, F.stddev_samp(m).over(frame))
        scores[f"{m}__roll_z"] = F.when(enough, z)
    return df.withColumns(scores).withColumns(
        {f"{m}__is_roll": _beyond(f"{m}__roll_z", threshold) for m in metrics}
    )


def flag_univariate(
    series: DataFrame,
    group_keys: Sequence[str],
    metrics: Sequence[str],
    date_col: str = "week_start",
    season_col: str = "semana",
    interpolation: str = "nearest",
) -> DataFrame:
    """All four detectors on all metrics of a series as long as the calendar; ``detect`` builds it."""
    flagged = flag_iqr(series, group_keys, metrics, interpolation=interpolation)
    flagged = flag_mad(flagged, group_keys, metrics)
    flagged = flag_rolling_z(flagged, group_keys, metrics, date_col)
    return flag_seasonal(flagged, group_keys, metrics, season_col)


def flag_columns(metrics: Sequence[str], forest: bool = False) -> list[str]:
    names = [f"{m}__is_{method}" for m in metrics for method in METHODS]
    return [*names, "is_iforest"] if forest else names
