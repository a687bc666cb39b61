"""Summaries of flagged series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekwatch.functions import any_true, count_true, long_form, safe_div

# Names of the methods in the reports, and the flag each one sets.
METHOD_LABELS: Mapping[str, str] = {
    "IQR": "{metric}__is_iqr",
    "MAD": "{metric}__is_mad",
    "Rolling": "{metric}__is_roll",
    "Seasonal": "{metric}__is_seas",
    "IForest": "is_iforest",
}


def outlier_summary(
    flagged: DataFrame, group_keys: Sequence[str], flags: Sequence[str]
) -> DataFrame:
    """How often each method fired in each group, and the length of the series."""
    return flagged.groupBy(*group_keys).agg(
        *(count_true(f).alias(f) for f in flags), F.count(F.lit(1)).alias("n_obs")
    )


def outlier_detail(
    flagged: DataFrame, keys: Sequence[str], metrics: Sequence[str], flags: Sequence[str]
) -> DataFrame:
    """The weeks that some method flags."""
    scores = [c for c in ("iforest_score",) if c in flagged.columns]
    return flagged.filter(any_true(flags)).select(*keys, *metrics, *flags, *scores)


def method_totals(summary: DataFrame, flags: Sequence[str]) -> DataFrame:
    """``method, flagged, pct`` over all groups of a summary, most frequent first."""
    totals = summary.agg(
        F.sum("n_obs").alias("n_obs"),
        *(F.coalesce(F.sum(f), F.lit(0)).cast("bigint").alias(f) for f in flags),
    )
    share = safe_div(F.col("flagged") * 100, F.col("n_obs"))
    return (
        totals.select("n_obs", long_form(flags, "method", "flagged"))
        .orderBy(F.desc("flagged"), "position")
        .select("method", "flagged", F.bround(share, 2).alias("pct"))
    )


def top_groups(
    summary: DataFrame, group_keys: Sequence[str], flag: str = "is_iforest", n: int = 5
) -> DataFrame:
    """The groups in which a method fired most often."""
    return (
        summary.select(*group_keys, flag, "n_obs").orderBy(F.desc(flag), *group_keys).limit(n)
    )


def _masks(columns: Sequence[str], metric: str) -> dict[str, str]:
    named = {label: flag.format(metric=metric) for label, flag in METHOD_LABELS.items()}
    return {label: flag for label, flag in named.items() if flag in columns}


def method_series(
    flagged: DataFrame, where: Column, metric: str, date_col: str = "week_start"
) -> DataFrame:
    """The series of one group in order, with a mask per method."""
    masks = [
        F.col(flag).alias(label) for label, flag in _masks(flagged.columns, metric).items()
    ]
    return flagged.filter(where).select(date_col, metric, *masks).orderBy(date_col)


def peak_labels(
    flagged: DataFrame,
    group_keys: Sequence[str],
    metric: str,
    date_col: str = "week_start",
    top_n: int = 4,
    k: int = 8,
) -> DataFrame:
    """The ``k`` highest flagged weeks per method, in the ``top_n`` groups with most MAD flags.

    ``flagged`` is read twice: pass a stored table. The list of groups has
    ``top_n`` rows by construction, which is what allows the broadcast.
    """
    mad = f"{metric}__is_mad"
    counts = flagged.groupBy(*group_keys).agg(count_true(mad).alias("n"))
    leaders = counts.orderBy(F.desc("n"), *group_keys).limit(top_n).drop("n")
    renamed = leaders.toDF(*(f"__top_{c}" for c in leaders.columns))
    same = [F.col(c).eqNullSafe(F.col(f"__top_{c}")) for c in group_keys]
    rows = flagged.join(F.broadcast(renamed), same, "left_semi")
    per_method = F.array(
        *(
            F.struct(F.lit(label).alias("method"), F.col(flag).alias("hit"))
            for label, flag in _masks(flagged.columns, metric).items()
        )
    )
    best = Window.partitionBy(*group_keys, "method").orderBy(F.desc(metric), date_col)
    return (
        rows.select(*group_keys, date_col, metric, F.inline(per_method))
        .filter("hit")
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= k)
        .select(*group_keys, "method", "place", date_col, metric)
    )
