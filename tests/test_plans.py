"""The three jobs, from stored tables to written reports."""

import pytest

from compare import spark_rows
from fixtures.weekly import WEEKLY_DEPT, WEEKLY_PROV, weekly_dept
from weekwatch.operators import silence
from weekwatch.operators.checks import flag_totals, issue_rows
from weekwatch.operators.profile import duplicate_count, temporal_coverage
from weekwatch.plans.cleaning import run_cleaning
from weekwatch.plans.detection import run_detection
from weekwatch.plans.validation import run_validation, validate
from weekwatch.sources.tables import read_csv, write_parquet

GONE = WEEKLY_PROV.with_(name="gone")


@pytest.fixture(scope="module")
def raw(spark, sf_dir, prov, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("raw"))
    write_parquet(prov, f"{folder}/weekly_prov.parquet")
    write_parquet(weekly_dept(spark, sf_dir, 3), f"{folder}/weekly_dept.parquet")
    return folder


def test_validation(spark, raw, prov, tmp_path):
    dept = WEEKLY_DEPT
    overview, missing = run_validation(spark, raw, str(tmp_path), [WEEKLY_PROV, GONE, dept])
    assert missing == ["gone"]
    rows = {r["tabla"]: r for r in overview.collect()}
    totals = flag_totals(prov, WEEKLY_PROV).first().asDict()
    duplicates = duplicate_count(prov, WEEKLY_PROV.key_cols).first()["duplicados"]
    row = rows["weekly_prov"].asDict()
    assert row["filas"] == totals.pop("n_rows") and row["duplicados"] == duplicates
    assert {n: row[n] for n in totals} == totals
    assert rows["weekly_dept"]["duplicados"] == rows["weekly_dept"]["filas"] * 2 // 3
    coverage = temporal_coverage(prov, ["department"], "week_start")
    back = read_csv(spark, f"{tmp_path}/integrity_gaps_weekly_prov.csv", coverage.schema)
    assert spark_rows(back) == spark_rows(coverage)
    issues = spark.read.parquet(f"{tmp_path}/integrity_issues_weekly_prov.parquet")
    assert spark_rows(issues) == spark_rows(issue_rows(prov, WEEKLY_PROV))
    assert spark.read.csv(f"{tmp_path}/integrity_overview.csv", header=True).count() == 2
    report = spark.read.csv(f"{tmp_path}/integrity_report.csv", header=True).collect()
    assert {r["tabla"]: int(r["issues"]) for r in report}["weekly_prov"] == issues.count()


def test_validate_describes_one_table(prov):
    found = validate(prov, WEEKLY_PROV)
    assert found.low_coverage.count() <= found.coverage.count() == 25
    assert found.top_nulls.first()["column"] == "hosp_total"
    assert found.check_ranking.count() == 20
    assert found.nulls_by_year.columns == ["ano", *WEEKLY_PROV.measure_cols]


def test_nothing_to_do(spark, tmp_path):
    assert run_validation(spark, str(tmp_path), str(tmp_path), [GONE]) == (None, ["gone"])
    assert run_cleaning(spark, str(tmp_path), str(tmp_path), str(tmp_path), [GONE]) == (None, ["gone"])
    assert run_detection(spark, str(tmp_path), str(tmp_path), [WEEKLY_DEPT]) == ({}, ["weekly_dept"])


def test_cleaning(spark, raw, prov, tmp_path):
    out = str(tmp_path)
    audit, _ = run_cleaning(spark, raw, f"{out}/processed", f"{out}/reports", [WEEKLY_PROV, WEEKLY_DEPT])
    rows = {r["name"]: r for r in audit.collect()}
    assert (rows["weekly_prov"]["in"], rows["weekly_prov"]["out"]) == (15924, 5308)
    cleaned = spark.read.parquet(f"{out}/processed/weekly_prov_cleaned.parquet")
    assert cleaned.count() == 5308
    assert cleaned.filter("flag_death_no_hosp").count() == rows["weekly_prov"]["flag_death_no_hosp"]
    report = silence.silence_report(prov, WEEKLY_PROV.silence_keys, WEEKLY_PROV)
    back = read_csv(spark, f"{out}/reports/silence_by_province.csv", report.schema)
    assert spark_rows(back) == spark_rows(report)
    assert spark.read.csv(f"{out}/reports/silence_top_province.csv", header=True).count() == 15


def test_detection(spark, raw, tmp_path):
    found, missing = run_detection(spark, raw, str(tmp_path), [WEEKLY_DEPT, WEEKLY_PROV])
    assert list(found) == ["weekly_dept"] and missing == []
    result = found["weekly_dept"]
    totals = {r["method"]: r["flagged"] for r in result.totals.collect()}
    sums = {c: sum(r[c] for r in result.summary.collect()) for c in totals}
    assert totals == sums
    detail = spark.read.parquet(f"{tmp_path}/outliers_detail_weekly_dept.parquet")
    assert detail.columns[-2:] == ["is_iforest", "iforest_score"]
    for flag, n in totals.items():
        assert detail.filter(flag).count() == n
    assert result.top_groups.count() == 5
    peaks = {r["method"] for r in result.peaks.collect()}
    assert "IForest" in peaks and "IQR" in peaks
