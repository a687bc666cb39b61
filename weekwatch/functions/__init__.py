"""Column expressions shared by the operators; all of them stay in the JVM."""

from weekwatch.functions.columns import (
    any_true,
    count_true,
    long_form,
    or_zero,
    percent,
    quoted,
    safe_div,
    silent,
    strata_exceed,
    total_exceeds,
)
from weekwatch.functions.quantiles import QUANTILE_MODES, group_median, group_quantiles

__all__ = [
    "QUANTILE_MODES",
    "any_true",
    "count_true",
    "group_median",
    "group_quantiles",
    "long_form",
    "or_zero",
    "percent",
    "quoted",
    "safe_div",
    "silent",
    "strata_exceed",
    "total_exceeds",
]
