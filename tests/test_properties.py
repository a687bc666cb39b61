"""Identities that hold for any table."""

import pytest

from compare import spark_rows
from fixtures.queries import METRICS, UNIVARIATE
from fixtures.weekly import WEEKLY_DEPT, WEEKLY_PROV, replicated, weekly_dept, weekly_prov
from weekwatch.operators import cleaning, iforest, outlier_reports, outliers, profile, silence
from weekwatch.sources.tables import conform
from weekwatch.operators.checks import SILENCE_CHECK, flag_names, flag_totals, issue_rows

SPEC = WEEKLY_PROV
REGION = SPEC.silence_keys


def test_duplicates_are_what_cleaning_removes(prov):
    cleaned = cleaning.clean_table(prov, SPEC).count()
    assert profile.duplicate_count(prov, SPEC.key_cols).first()["duplicados"] == prov.count() - cleaned


def test_observed_weeks_are_the_rows_of_the_series(prov, series):
    coverage = profile.temporal_coverage(prov, ["department"], "week_start")
    assert coverage.agg({"n_observado": "sum"}).first()[0] == series.count()


def test_silence_adds_up_to_the_check(prov):
    report = silence.silence_report(prov, REGION, SPEC).collect()
    assert sum(r["n_obs"] for r in report) == prov.count()
    silent = sum(round(r["pct_silence"] * r["n_obs"] / 100) for r in report)
    assert silent == flag_totals(prov, SPEC).first()[SILENCE_CHECK]


def test_coverage_arithmetic(prov):
    for r in profile.temporal_coverage(prov, REGION, "week_start").collect():
        assert r["n_faltantes"] == r["n_esperado"] - r["n_observado"] >= 0
        assert r["pct_cobertura"] == pytest.approx(100 * r["n_observado"] / r["n_esperado"], abs=0.0051)


def test_summary_columns_add_up_to_the_totals(series):
    summary = outlier_reports.outlier_summary(
        outliers.flag_univariate(series, ["department"], METRICS), ["department"], UNIVARIATE
    )
    rows = summary.collect()
    for r in outlier_reports.method_totals(summary, UNIVARIATE).collect():
        assert r["flagged"] == sum(row[r["method"]] for row in rows)


def test_forest_flags_one_percent(series):
    scored = iforest.flag_isolation_forest(series, ["department"], METRICS)
    groups = scored.groupBy("department").agg({"is_iforest": "count_if", "*": "count"}).collect()
    for r in groups:
        # Strictly beyond the threshold: ties at it can only make it fewer.
        assert r["count_if(is_iforest)"] <= int(0.01 * (r["count(1)"] - 1)) + 1


def test_issue_rows_are_between_the_largest_check_and_the_sum(prov):
    totals = flag_totals(prov, SPEC).first()
    counts = [totals[n] for n in flag_names(SPEC)]
    assert max(counts) <= issue_rows(prov, SPEC).count() <= sum(counts)


def test_cleaning_twice_is_cleaning_once(prov):
    once = cleaning.clean_table(prov, SPEC)
    again = cleaning.deduplicate(
        once, SPEC.natural_key, SPEC.metrics, SPEC.passthrough, SPEC.tie_break
    )
    flags = (cleaning.DEATH_FLAG, cleaning.CLAMP_FLAG)
    assert spark_rows(again) == spark_rows(once.drop(*flags))
    assert once.filter("coalesce(hosp_total, 0) > coalesce(cases_total, 0)").count() == 0
    assert once.filter(cleaning.CLAMP_FLAG).count() > 0


@pytest.mark.parametrize("n", [1, 7, 64])
def test_partitioning_changes_nothing(prov, series, n):
    moved, moved_series = prov.repartition(n), series.repartition(n)
    pairs = [
        (lambda df: cleaning.clean_table(df, SPEC), prov, moved),
        (lambda df: silence.silence_report(df, REGION, SPEC), prov, moved),
        (lambda df: profile.integrity_cells(df, SPEC), prov, moved),
        (lambda s: outliers.flag_univariate(s, ["department"], METRICS), series, moved_series),
    ]
    for operator, before, after in pairs:
        assert spark_rows(operator(before)) == spark_rows(operator(after))


# Counts on the derived tables, rows then checks.
PROV_COUNTS = {
    "n_rows": 15924,
    "_chk_null__hosp_total": 153,
    "_chk_neg__hosp_under5": 132,
    "_chk_strata__hosp": 27,
    "_chk_strata__deaths": 156,
    "_chk_logic__hosp_gt_cases": 183,
    "_chk_logic__deaths_gt_cases": 57,
    "_chk_logic__deaths_gt_hosp": 201,
    "_chk_range__year": 174,
    "_chk_range__week": 186,
    SILENCE_CHECK: 10098,
}
SERIES_COUNTS = {
    "cases_total": (356, 0, 29, 3),
    "hosp_total": (114, 0, 9, 2),
    "deaths_total": (352, 0, 126, 0),
}


def test_known_counts(prov, series):
    totals = flag_totals(prov, SPEC).first()
    assert {n: totals[n] for n in PROV_COUNTS} == PROV_COUNTS
    flagged = outliers.flag_univariate(series, ["department"], METRICS)
    summary = outlier_reports.outlier_summary(flagged, ["department"], UNIVARIATE)
    found = {r["method"]: r["flagged"] for r in outlier_reports.method_totals(summary, UNIVARIATE).collect()}
    for metric, counts in SERIES_COUNTS.items():
        assert tuple(found[f"{metric}__is_{m}"] for m in outliers.METHODS) == counts


def test_replicas_do_not_change_the_series(spark, sf_dir, series):
    from weekwatch.plans.detection import series_of

    assert spark_rows(series_of(weekly_dept(spark, sf_dir, 6), WEEKLY_DEPT)) == spark_rows(series)


def test_one_region_with_most_of_the_rows(prov):
    """Repeating one region's rows changes its row counts and nothing else."""
    hot = "department = 'NATION_3'"
    skewed = prov.unionByName(replicated(prov.filter(hot), 49))
    assert skewed.filter(hot).count() > 0.6 * skewed.count()

    def unchanged(operator, *dropped):
        assert spark_rows(operator(skewed).drop(*dropped)) == spark_rows(operator(prov).drop(*dropped))

    unchanged(lambda df: cleaning.clean_table(df, SPEC))
    unchanged(lambda df: profile.temporal_coverage(df, ["department"], "week_start"))
    unchanged(lambda df: profile.null_pct_by(df, SPEC.measure_cols, ["department"]))
    unchanged(lambda df: silence.silence_report(df, REGION, SPEC), "n_obs")
    unchanged(lambda df: outliers.weekly_series(df, ["department"], "week_start", METRICS))
    added = skewed.count() - prov.count()
    before, after = (profile.duplicate_count(df, SPEC.key_cols).first()[0] for df in (prov, skewed))
    assert after - before == added


def test_nothing_relies_on_broadcasts(spark, sf_dir, prov, series):
    expected = spark_rows(iforest.flag_isolation_forest(series, ["department"], METRICS))
    table = spark_rows(prov)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert spark_rows(iforest.flag_isolation_forest(series, ["department"], METRICS)) == expected
        assert spark_rows(conform(weekly_prov(spark, sf_dir), SPEC)) == table
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
