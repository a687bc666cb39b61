"""Outlier detection on the weekly series of a set of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weekwatch.operators import outlier_reports as reports
from weekwatch.operators.iforest import flag_isolation_forest
from weekwatch.operators.outliers import flag_columns, flag_univariate, weekly_series
from weekwatch.plans.common import each_table, together
from weekwatch.sources.scratch import job_folder, store
from weekwatch.sources.tables import write_csv, write_parquet
from weekwatch.specs import SURVEILLANCE, TableSpec


def series_of(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The table's weekly series, with year and week."""
    return weekly_series(
        df, spec.group_keys, spec.date_col, spec.detect_metrics, (spec.year_col, spec.week_col)
    )


def flag_all(series: DataFrame, spec: TableSpec) -> DataFrame:
    """A stored series with the scores and flags of all five detectors."""
    keys, metrics, date = spec.group_keys, spec.detect_metrics, spec.date_col
    scored = flag_isolation_forest(series, keys, metrics, date)
    return flag_univariate(scored, keys, metrics, date, spec.week_col)


@dataclass(frozen=True)
class Detection:
    flagged: DataFrame
    summary: DataFrame
    detail: DataFrame
    totals: DataFrame
    top_groups: DataFrame
    peaks: DataFrame


def findings(flagged: DataFrame, spec: TableSpec) -> Detection:
    """Everything that is read off a stored flagged series."""
    keys, metrics = spec.group_keys, spec.detect_metrics
    flags = flag_columns(metrics, forest=True)
    summary = reports.outlier_summary(flagged, keys, flags)
    dated = [*keys, spec.year_col, spec.week_col, spec.date_col]
    primary = "cases_total" if "cases_total" in metrics else metrics[0]
    return Detection(
        flagged=flagged,
        summary=summary,
        detail=reports.outlier_detail(flagged, dated, metrics, flags),
        totals=reports.method_totals(summary, flags),
        top_groups=reports.top_groups(summary, keys),
        peaks=reports.peak_labels(flagged, keys, primary, spec.date_col),
    )


def detect(df: DataFrame, spec: TableSpec) -> Detection:
    """Build the series, run the detectors, summarise.

    The table is read once: the series and the flagged series are stored, both of
    them as small as the calendar, and everything else reads those.
    """
    series = store(series_of(df, spec), f"series-{spec.name}")
    return findings(store(flag_all(series, spec), f"flagged-{spec.name}"), spec)


def run_detection(
    spark: SparkSession, raw_dir: str, out_dir: str, specs: Sequence[TableSpec] = SURVEILLANCE
) -> tuple[dict[str, Detection], list[str]]:
    """Detect outliers in the tables of a folder that name metrics, and write the findings.

    The flagged series is one of the written tables; what is returned reads it.
    """

    def work(df: DataFrame, spec: TableSpec, scratch: str) -> Detection:
        name = spec.detect_name or spec.name
        series = store(series_of(df, spec), f"series-{spec.name}", scratch)
        flagged, path = flag_all(series, spec), f"{out_dir}/outliers_flagged_{name}.parquet"
        write_parquet(flagged, path)
        found = findings(spark.read.schema(flagged.schema).parquet(path), spec)
        ordered = found.summary.orderBy(*spec.group_keys)
        together(
            lambda: write_csv(ordered, f"{out_dir}/outliers_summary_{name}.csv"),
            lambda: write_csv(found.totals, f"{out_dir}/outliers_report_{name}.csv"),
            lambda: write_csv(found.top_groups, f"{out_dir}/outliers_top_{name}.csv"),
            lambda: write_csv(found.peaks, f"{out_dir}/outliers_peaks_{name}.csv"),
            lambda: write_parquet(found.detail, f"{out_dir}/outliers_detail_{name}.parquet"),
        )
        return found

    wanted = [spec for spec in specs if spec.detect_metrics]
    with job_folder(spark) as scratch:
        return each_table(spark, raw_dir, wanted, lambda df, spec: work(df, spec, scratch))
