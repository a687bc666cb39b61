"""Repeatable corrections: one row per natural key, audit flags, a conservative clamp."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwatch.functions import count_true, total_exceeds
from weekwatch.specs import TableSpec

DEATH_FLAG = "flag_death_no_hosp"
CLAMP_FLAG = "flag_hosp_corrected"


def deduplicate(
    df: DataFrame,
    key: Sequence[str],
    metrics: Sequence[str],
    passthrough: Sequence[str] = (),
    tie_break: str | None = None,
) -> DataFrame:
    """One row per key: the largest value of each metric, pass-through values of one row.

    That row has the smallest ``tie_break``, then the smallest pass-through values,
    each with null last; so the result does not depend on row order, and no row is
    left out for a missing value. Rows are first collapsed by key and pass-through
    values, with buffers of fixed width, so raw rows are hashed and never sorted; the
    choice is then among the few different rows that are left of a key.
    """
    largest = [F.max(c).alias(c) for c in metrics]
    if not passthrough:
        return df.groupBy(*key).agg(*largest) if largest else df.select(*key).distinct()
    order = dict.fromkeys([tie_break, *passthrough] if tie_break else passthrough)
    apart = [c for c in order if c not in key]
    collapsed = df.groupBy(*key, *apart).agg(*largest) if largest else df.select(*key, *apart).distinct()
    values = [part for i, c in enumerate(order) for part in (F.isnull(c).alias(f"n{i}"), F.col(c).alias(f"v{i}"))]
    kept = collapsed.groupBy(*key).agg(*largest, F.min(F.struct(*values)).alias("__kept"))
    at = {c: i for i, c in enumerate(order)}
    return kept.select(*key, *metrics, *(F.col(f"__kept.v{at[c]}").alias(c) for c in passthrough))


def flag_deaths_gt_hosp(
    df: DataFrame, hosp: str = "hosp_total", deaths: str = "deaths_total"
) -> DataFrame:
    """Mark rows with more deaths than admissions; they may be deaths at home."""
    return df.withColumn(DEATH_FLAG, total_exceeds(deaths, hosp))


def clamp_hosp_gt_cases(
    df: DataFrame, cases_col: str = "cases_total", hosp: str = "hosp_total"
) -> DataFrame:
    """Raise the cases to the admissions where they are fewer, and mark the row."""
    fewer = total_exceeds(hosp, cases_col)
    return df.withColumns(
        {CLAMP_FLAG: fewer, cases_col: F.when(fewer, F.col(hosp)).otherwise(F.col(cases_col))}
    )


def clean_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Deduplicate, then flag, then clamp: one shuffle, the rest fused behind it."""
    rows = deduplicate(df, spec.natural_key, spec.metrics, spec.passthrough, spec.tie_break)
    flagged = flag_deaths_gt_hosp(rows, spec.hosp.total, spec.deaths.total)
    return clamp_hosp_gt_cases(flagged, spec.cases_col, spec.hosp.total)


def cleaning_audit(raw: DataFrame, cleaned: DataFrame, name: str) -> DataFrame:
    """One row: rows in and out, duplicates removed, rows flagged and corrected."""
    flags = (DEATH_FLAG, CLAMP_FLAG)
    before = raw.select(F.lit(1).alias("before"), *(F.lit(False).alias(f) for f in flags))
    after = cleaned.select(F.lit(0).alias("before"), *flags)
    return (
        before.unionAll(after)
        .agg(
            F.count_if(F.col("before") == 1).alias("rows_in"),
            F.count_if(F.col("before") == 0).alias("rows_out"),
            *(count_true(f).alias(f) for f in flags),
        )
        .select(
            F.lit(name).alias("name"),
            F.col("rows_in").alias("in"),
            F.col("rows_out").alias("out"),
            (F.col("rows_in") - F.col("rows_out")).alias("dups_removed"),
            *flags,
        )
    )
