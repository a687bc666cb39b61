"""Validation of a set of tables.

Each table is read three times, and each time only the columns needed: once for
the cells, from which all counts follow; once for the keys; once for the rows
with issues.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weekwatch.operators import profile
from weekwatch.operators.checks import issue_rows
from weekwatch.plans.common import each_table, together
from weekwatch.sources.scratch import job_folder, store
from weekwatch.sources.tables import read_csv, write_csv, write_parquet
from weekwatch.specs import SURVEILLANCE, TableSpec


@dataclass(frozen=True)
class Validation:
    """What validation finds about one table, read off its stored cells and duplicate count."""

    table: DataFrame
    spec: TableSpec
    cells: DataFrame
    duplicates: DataFrame

    @property
    def totals(self) -> DataFrame:
        return profile.flag_totals_from_cells(self.cells, self.spec)

    @property
    def overview(self) -> DataFrame:
        return profile.table_overview(self.totals, self.duplicates, self.spec)

    @property
    def check_ranking(self) -> DataFrame:
        return profile.check_ranking(self.totals, self.spec)

    @property
    def issue_ranking(self) -> DataFrame:
        return profile.issue_ranking(self.totals, self.duplicates, self.spec)

    @property
    def coverage(self) -> DataFrame:
        return profile.temporal_coverage(self.cells, self.spec.group_keys, self.spec.date_col)

    @property
    def low_coverage(self) -> DataFrame:
        return profile.low_coverage(self.coverage)

    @property
    def null_profile(self) -> DataFrame:
        return profile.null_profile_from_cells(self.cells, self.table.columns)

    @property
    def top_nulls(self) -> DataFrame:
        return profile.top_null_columns(self.null_profile, self.table.columns)

    @property
    def nulls_by_group(self) -> DataFrame:
        spec = self.spec
        return profile.null_pct_by_from_cells(self.cells, spec.measure_cols, spec.group_keys)

    @property
    def nulls_by_year(self) -> DataFrame:
        spec = self.spec
        return profile.null_pct_by_from_cells(self.cells, spec.measure_cols, [spec.year_col])

    @property
    def issues(self) -> DataFrame:
        return issue_rows(self.table, self.spec)


# Names of the written tables, and what they hold.
REPORTS = {
    "gaps": "coverage",
    "low_coverage": "low_coverage",
    "summary": "null_profile",
    "top_nulls": "top_nulls",
    "nulls": "nulls_by_group",
    "timeline": "nulls_by_year",
    "ranking": "issue_ranking",
    "checks": "check_ranking",
}


def validate(df: DataFrame, spec: TableSpec, folder: str | None = None) -> Validation:
    """Count the cells and the duplicates of a table; the findings are derived when asked for.

    Both counts are stored in ``folder``, by default the session's scratch folder.
    """
    cells, duplicates = together(
        lambda: store(profile.integrity_cells(df, spec), f"cells-{spec.name}", folder),
        lambda: store(
            profile.duplicate_count(df, spec.key_cols), f"duplicates-{spec.name}", folder
        ),
    )
    return Validation(df, spec, cells, duplicates)


def run_validation(
    spark: SparkSession, raw_dir: str, out_dir: str, specs: Sequence[TableSpec] = SURVEILLANCE
) -> tuple[DataFrame | None, list[str]]:
    """Validate the tables in a folder and write the findings.

    Returns the written overview (one row per table) and the names of missing tables;
    intermediate tables are removed.
    """
    with job_folder(spark) as scratch:
        return _validate_all(spark, raw_dir, out_dir, specs, scratch)


def _validate_all(
    spark: SparkSession, raw_dir: str, out_dir: str, specs: Sequence[TableSpec], scratch: str
) -> tuple[DataFrame | None, list[str]]:
    def work(df: DataFrame, spec: TableSpec) -> Validation:
        issues = f"{out_dir}/integrity_issues_{spec.name}.parquet"
        found, _ = together(
            lambda: validate(df, spec, scratch), lambda: write_parquet(issue_rows(df, spec), issues)
        )
        paths = {name: f"{out_dir}/integrity_{kind}_{spec.name}.csv" for kind, name in REPORTS.items()}
        together(
            *(lambda n=n, path=path: write_csv(getattr(found, n), path) for n, path in paths.items())
        )
        return found

    done, missing = each_table(spark, raw_dir, specs, work)
    if not done:
        return None, missing
    overview = profile.integrity_overview([found.overview for found in done.values()])
    write_csv(overview, f"{out_dir}/integrity_overview.csv")
    overview = read_csv(spark, f"{out_dir}/integrity_overview.csv", overview.schema)
    # Rows with issues are counted from the footers of what was written.
    issues = {
        name: spark.read.parquet(f"{out_dir}/integrity_issues_{name}.parquet").count()
        for name in done
    }
    per_table = spark.createDataFrame(list(issues.items()), "tabla string, issues bigint")
    report = overview.select("tabla", "filas", "duplicados").join(per_table, "tabla")
    write_csv(report.select("tabla", "filas", "issues", "duplicados"), f"{out_dir}/integrity_report.csv")
    return overview, missing
