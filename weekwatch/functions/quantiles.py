"""Quantiles of columns within a group, attached to every row of the group.

They are window aggregates, so the rows of a group meet in one task. Callers
pass weekly series, which hold one row per group and calendar date: however
many raw rows a region has, its series is no longer than the calendar.

All columns are handled together: windows with the same keys that stand in the
same projection become one operator in the plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILE_MODES = ("nearest", "linear", "approx")


def group_median(name: str | Column, keys: Sequence[str]) -> Column:
    """Middle value, or the mean of the two middle ones, over the group."""
    return F.median(name).over(Window.partitionBy(*keys))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    quantiles: Mapping[str, float],
    mode: str = "nearest",
) -> DataFrame:
    """Add ``<prefix><name>`` for every name and every entry of ``quantiles`` (prefix: fraction).

    ``nearest`` takes the observed value at the rounded rank ``(n - 1) * q``
    (halves up), ``linear`` interpolates, ``approx`` uses Spark's sketch.
    """
    group = Window.partitionBy(*keys)
    wanted = [(f"{prefix}{c}", c, q) for c in names for prefix, q in quantiles.items()]
    if mode == "linear":
        return df.withColumns({out: F.percentile(c, q).over(group) for out, c, q in wanted})
    if mode == "approx":
        return df.withColumns({out: F.percentile_approx(c, q).over(group) for out, c, q in wanted})
    if mode != "nearest":
        raise ValueError(f"mode must be one of {QUANTILE_MODES}, not {mode!r}")
    ranks = {
        f"__rank_{c}": F.row_number().over(group.orderBy(F.col(c).asc_nulls_last())) for c in names
    }
    sizes = {f"__size_{c}": F.count(c).over(group) for c in names}
    picked = {}
    for out, c, q in wanted:
        place = F.floor((F.col(f"__size_{c}") - 1) * F.lit(q) + 0.5) + 1
        picked[out] = F.max(F.when(F.col(f"__rank_{c}") == place, F.col(c))).over(group)
    return df.withColumns({**ranks, **sizes}).withColumns(picked).drop(*ranks, *sizes)
