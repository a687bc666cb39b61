"""What can be said about a table as a whole: duplicates, coverage, missing values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwatch.functions import count_true, long_form, percent, quoted, safe_div
from weekwatch.operators.checks import CHECK_PREFIX, flag_expressions, flag_names
from weekwatch.specs import TableSpec

# Days of a week, and the limits of the reports in percent.
WEEK_DAYS = 7
LOW_COVERAGE = 95.0
SEVERE_PERCENT = 1.0
_NULLS = "nulls__"


def duplicate_count(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """One row: ``duplicados``, the rows beyond the first of each key. Null is a key value."""
    return rows_beyond_first(df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("n")))


def rows_beyond_first(per_key: DataFrame) -> DataFrame:
    """``duplicate_count`` of the table whose rows per key are counted as ``n``."""
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint")
    return per_key.agg(extra.alias("duplicados"))


def temporal_coverage(
    df: DataFrame, group_keys: Sequence[str], date_col: str, step_days: int = WEEK_DAYS
) -> DataFrame:
    """Observed against expected weeks between the first and last date of each group.

    Distinct dates are found per (group, date) before groups are formed, so a
    region with most of the rows is spread over its dates.
    """
    dates = df.select(*group_keys, date_col).distinct()
    spans = dates.groupBy(*group_keys).agg(
        F.min(date_col).alias("date_min"),
        F.max(date_col).alias("date_max"),
        F.count(F.lit(1)).alias("n_observado"),
    )
    days = F.datediff("date_max", "date_min")
    expected = (F.floor(days / F.lit(step_days)) + 1).cast("bigint")
    return (
        spans.withColumn("n_esperado", expected)
        .withColumns(
            {
                "pct_cobertura": percent(F.col("n_observado"), F.col("n_esperado"), 2),
                "n_faltantes": F.col("n_esperado") - F.col("n_observado"),
            }
        )
        .orderBy("pct_cobertura", *group_keys)
    )


def low_coverage(coverage: DataFrame, below: float = LOW_COVERAGE) -> DataFrame:
    """Groups that miss too many weeks."""
    return coverage.filter(F.col("pct_cobertura") < below)


def integrity_cells(
    df: DataFrame, spec: TableSpec, apart: Sequence[str] = (), columns: Sequence[str] | None = None
) -> DataFrame:
    """Row, missing-value and flag counts per (group, year, date), and per value of the columns ``apart``.

    One pass over the table with map-side aggregation; as many rows as there
    are groups and dates. The totals, the null profiles and the coverage can all
    be read off the cells without going back to the table. Missing values are
    counted for ``columns``, all of the table's unless given.
    """
    keys = list(dict.fromkeys((*apart, *spec.group_keys, spec.year_col, spec.date_col)))
    flags = [count_true(e).alias(n) for n, e in flag_expressions(spec).items()]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *_null_counts(columns or df.columns), *flags
    )


def _null_counts(columns: Sequence[str]) -> list:
    return [F.expr(f"count_if({quoted(c)} is null) as {quoted(_NULLS + c)}") for c in columns]


def _add_up(names: Sequence[str]) -> list:
    return [F.expr(f"coalesce(sum({quoted(c)}), 0L) as {quoted(c)}") for c in names]


def flag_totals_from_cells(cells: DataFrame, spec: TableSpec) -> DataFrame:
    """``flag_totals`` of the table behind the cells."""
    return cells.agg(*_add_up(["n_rows", *flag_names(spec)]))


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values of every column: ``column, nulls, pct``, most missing first."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *_null_counts(df.columns))
    return _profile(counts, df.columns)


def null_profile_from_cells(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``null_profile`` of the table behind the cells."""
    counts = cells.agg(*_add_up(["n_rows", *(f"{_NULLS}{c}" for c in columns)]))
    return _profile(counts, columns)


def _profile(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (
        counts.select("n_rows", long_form(columns, "column", "nulls", _NULLS))
        .withColumn("pct", percent(F.col("nulls"), F.col("n_rows"), 3, empty=0.0))
        .orderBy(F.desc("nulls"), "position")
        .select("column", "nulls", "pct")
    )


def top_null_columns(profile: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The columns with most missing values, if any are missing; ties in table order."""
    position = F.array_position(F.array(*(F.lit(c) for c in columns)), F.col("column"))
    return profile.filter(F.col("nulls") > 0).orderBy(F.desc("nulls"), position).limit(n)


def null_pct_by(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Percent missing of each column per group, e.g. per region or per year."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *_null_counts(cols))
    return _null_shares(counts, cols, keys)


def null_pct_by_from_cells(
    cells: DataFrame, cols: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """``null_pct_by`` of the table behind the cells."""
    counts = cells.groupBy(*keys).agg(
        *_add_up(["n_rows", *(f"{_NULLS}{c}" for c in cols)])
    )
    return _null_shares(counts, cols, keys)


def _null_shares(counts: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    shares = [percent(F.col(f"{_NULLS}{c}"), F.col("n_rows"), 2).alias(c) for c in cols]
    return counts.select(*keys, *shares).orderBy(*keys)


def table_overview(totals: DataFrame, duplicates: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per table: rows, duplicates, and count and percent of every check."""
    checks: list = []
    for name in flag_names(spec):
        share = F.bround(safe_div(F.col(name) * 100, F.col("n_rows")), 3)
        checks += [F.col(name), F.coalesce(share, F.lit(0.0)).alias(f"{name}_pct")]
    return _with_duplicates(totals, duplicates).select(
        F.lit(spec.name).alias("tabla"), F.col("n_rows").alias("filas"), "duplicados", *checks
    )


def _with_duplicates(totals: DataFrame, duplicates: DataFrame) -> DataFrame:
    """The one-row totals and the one-row duplicate count as one row."""
    both = totals.unionByName(duplicates, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def integrity_overview(tables: Sequence[DataFrame]) -> DataFrame:
    """The ``table_overview`` rows of several tables."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _checks_long(totals: DataFrame, names: Sequence[str]) -> DataFrame:
    """``position, check, count, pct``, one row per name."""
    share = safe_div(F.col("count") * 100, F.col("n_rows"))
    return totals.select("n_rows", long_form(names, "check", "count")).select(
        "position", "check", "count", F.coalesce(share, F.lit(0.0)).alias("pct")
    )


def check_ranking(totals: DataFrame, spec: TableSpec) -> DataFrame:
    """Every check by how many rows it marks; ``severe`` from one percent on."""
    return (
        _checks_long(totals, flag_names(spec))
        .orderBy(F.desc("count"), "position")
        .select("check", "count", "pct", (F.col("pct") >= SEVERE_PERCENT).alias("severe"))
    )


def issue_ranking(totals: DataFrame, duplicates: DataFrame, spec: TableSpec) -> DataFrame:
    """The checks that found something, and the duplicates, by rows affected."""
    found = f"{CHECK_PREFIX}duplicates"
    both = _with_duplicates(totals, duplicates).withColumnRenamed("duplicados", found)
    return (
        _checks_long(both, [*flag_names(spec), found])
        .filter(F.col("count") > 0)
        .orderBy("count", "position")
        .select(F.regexp_replace("check", f"^{CHECK_PREFIX}", "").alias("check"), "count", "pct")
    )
