"""Under-reporting: weeks with cases but neither admissions nor deaths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.functions import count_true, safe_div, silent
from weekwatch.specs import TableSpec

SLOPE = "slope_pct_per_year"


def _counts(df: DataFrame, keys: Sequence[str], spec: TableSpec) -> DataFrame:
    quiet = silent(spec.cases_col, spec.hosp.total, spec.deaths.total)
    return df.groupBy(*keys).agg(
        count_true(quiet).alias("n_silent"), F.count(F.lit(1)).alias("n_obs")
    )


def _share() -> Column:
    return safe_div(F.col("n_silent"), F.col("n_obs")) * 100


def silence_rate(df: DataFrame, keys: Sequence[str], spec: TableSpec) -> DataFrame:
    """``pct_silence`` and ``n_obs`` per region, over the rows as they are."""
    return _counts(df, keys, spec).select(
        *keys, F.bround(_share(), 3).alias("pct_silence"), "n_obs"
    )


def silence_rate_yearly(df: DataFrame, keys: Sequence[str], spec: TableSpec) -> DataFrame:
    """``pct`` per region and year."""
    keys = [*keys, spec.year_col]
    return _counts(df, keys, spec).select(*keys, _share().alias("pct"))


def _slope(pct: Column, year: Column) -> Column:
    """Least-squares slope; 0 with fewer than two years or a single repeated year."""
    return F.bround(F.coalesce(F.regr_slope(pct, year.cast("double")), F.lit(0.0)), 4)


def trend_slope(yearly: DataFrame, keys: Sequence[str], year_col: str) -> DataFrame:
    """Change of the yearly share, in points per year."""
    return yearly.groupBy(*keys).agg(_slope(F.col("pct"), F.col(year_col)).alias(SLOPE))


def silence_report(df: DataFrame, keys: Sequence[str], spec: TableSpec) -> DataFrame:
    """Rate and trend per region, most silent first.

    The yearly counts add up to the overall ones, so one pass over the table and
    a second aggregation of a few rows per region give both. A region with a
    missing key has no trend: its name cannot be matched between years.
    """
    yearly = _counts(df, [*keys, spec.year_col], spec).withColumn("pct", _share())
    named = F.lit(True)
    for key in keys:
        named = named & F.col(key).isNotNull()
    regions = yearly.groupBy(*keys).agg(
        F.sum("n_silent").alias("n_silent"),
        F.sum("n_obs").alias("n_obs"),
        _slope(F.col("pct"), F.col(spec.year_col)).alias(SLOPE),
    )
    return regions.select(
        *keys,
        F.bround(_share(), 3).alias("pct_silence"),
        "n_obs",
        F.when(named, F.col(SLOPE)).alias(SLOPE),
    ).orderBy(F.desc("pct_silence"), *keys)


def top_silent(report: DataFrame, keys: Sequence[str], n: int = 15) -> DataFrame:
    """The regions that report least."""
    return report.orderBy(F.desc("pct_silence"), *keys).limit(n)


def trend_reading(report: DataFrame) -> DataFrame:
    """Name the direction of the trend: a rising share of silence is worse reporting."""
    slope = F.col(SLOPE)
    reading = F.when(slope > 0, "worsens").when(slope < 0, "improves").when(slope == 0, "steady")
    return report.withColumn("trend", reading)
