"""Checks that need nothing but the row itself. No shuffle, one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.functions import (
    any_true,
    count_true,
    or_zero,
    silent,
    strata_exceed,
    total_exceeds,
)
from weekwatch.specs import TableSpec

# Names of the checks.
CHECK_PREFIX = "_chk_"
NULL_CHECK = "_chk_null__"
NEGATIVE_CHECK = "_chk_neg__"
SILENCE_CHECK = "_chk_silence__no_hosp_no_death_with_cases"


def _outside(name: str, bounds: tuple[int, int]) -> Column:
    low, high = bounds
    return (F.col(name) < low) | (F.col(name) > high)


# The checks that do not belong to one measure.
TABLE_CHECKS = (
    "_chk_strata__hosp",
    "_chk_strata__deaths",
    "_chk_logic__hosp_gt_cases",
    "_chk_logic__deaths_gt_cases",
    "_chk_logic__deaths_gt_hosp",
    "_chk_range__year",
    "_chk_range__week",
    SILENCE_CHECK,
)


def flag_names(spec: TableSpec) -> list[str]:
    per_measure = [f"{check}{c}" for check in (NULL_CHECK, NEGATIVE_CHECK) for c in spec.measure_cols]
    return [*per_measure, *TABLE_CHECKS]


def flag_expressions(spec: TableSpec) -> dict[str, Column]:
    """Flag name to predicate. A missing year or week leaves its range flag null."""
    hosp, deaths, cases = spec.hosp.total, spec.deaths.total, spec.cases_col
    predicates = [
        *(F.col(c).isNull() for c in spec.measure_cols),
        *(or_zero(c) < 0 for c in spec.measure_cols),
        strata_exceed(spec.hosp),
        strata_exceed(spec.deaths),
        total_exceeds(hosp, cases),
        total_exceeds(deaths, cases),
        total_exceeds(deaths, hosp),
        _outside(spec.year_col, spec.year_bounds),
        _outside(spec.week_col, spec.week_bounds),
        silent(cases, hosp, deaths),
    ]
    return dict(zip(flag_names(spec), predicates, strict=True))


def add_flags(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The table with one boolean ``_chk_*`` column per check."""
    return df.withColumns(flag_expressions(spec))


def flag_totals(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One row: ``n_rows`` and how many rows each check marks."""
    marked = [count_true(e).alias(n) for n, e in flag_expressions(spec).items()]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *marked)


def issue_columns(spec: TableSpec) -> list[str]:
    """Region, key, measures and flags, each name once."""
    names: Sequence[str] = (
        *spec.group_keys,
        *spec.key_cols,
        *spec.measure_cols,
        spec.cases_col,
        *flag_names(spec),
    )
    return list(dict.fromkeys(names))


def issue_rows(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows that at least one check marks."""
    return (
        add_flags(df, spec).filter(any_true(flag_names(spec))).select(*issue_columns(spec))
    )
