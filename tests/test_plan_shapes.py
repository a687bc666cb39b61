"""What Spark makes of the operators: shuffles, windows, pushed-down columns."""

import re

import pytest
from pyspark.sql import functions as F

from fixtures.queries import METRICS
from fixtures.weekly import WEEKLY_PROV as SPEC
from weekwatch.operators import checks, cleaning, iforest, outliers, profile, silence
from weekwatch.operators import outlier_reports as reports
from weekwatch.specs import SURVEILLANCE

G = ["department"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, operator) -> int:
    return len(re.findall(rf"[-:] \*?(?:\(\d+\) )?{operator}\b", plan(df)))


def read_columns(df) -> list[str]:
    scan = re.search(r"FileScan parquet \[([^\]]*)\]", plan(df)).group(1)
    return [re.sub(r"#\d+L?", "", c) for c in scan.split(",")]


def test_row_checks_do_not_shuffle(prov):
    assert count(checks.issue_rows(prov, SPEC), "Exchange") == 0


@pytest.mark.parametrize("make, shuffles", [
    (lambda p: checks.flag_totals(p, SPEC), 1),
    (lambda p: profile.integrity_cells(p, SPEC), 1),
    (lambda p: profile.null_pct_by(p, SPEC.measure_cols, G), 2),
])
def test_one_pass_and_map_side_aggregation(prov, make, shuffles):
    df = make(prov)
    assert count(df, "Exchange") <= shuffles
    assert count(df, "SortAggregate") == 0
    assert re.search(r"functions=\[partial_", plan(df))


def test_silence_report_reads_once_and_does_not_join(prov):
    df = silence.silence_report(prov, SPEC.silence_keys, SPEC)
    assert plan(df).count("FileScan") == 1 and "Join" not in plan(df)


def test_only_needed_columns_are_read(prov):
    assert set(read_columns(profile.duplicate_count(prov, SPEC.key_cols))) == set(SPEC.key_cols)
    coverage = profile.temporal_coverage(prov, G, "week_start")
    assert set(read_columns(coverage)) == {"department", "week_start"}
    rate = silence.silence_rate(prov, SPEC.silence_keys, SPEC)
    assert len(read_columns(rate)) == 5


def test_detectors_share_one_shuffle(series):
    df = outliers.flag_univariate(series, G, METRICS)
    assert count(df, "Exchange") == 1
    assert plan(df).count("FileScan") == 1 and "Join" not in plan(df)
    # A rank per metric for the quartiles; everything else takes all metrics at once.
    assert count(df, "Window") <= len(METRICS) + 2 + 2 + 1 + 2
    assert "Python" not in plan(df)


def test_rolling_is_one_window(series):
    assert count(outliers.flag_rolling_z(series, G, METRICS), "Window") == 1


def test_no_cross_joins_and_python_only_in_the_forest(prov, series):
    totals, duplicates = checks.flag_totals(prov, SPEC), profile.duplicate_count(prov, SPEC.key_cols)
    for df in (
        profile.table_overview(totals, duplicates, SPEC),
        profile.issue_ranking(totals, duplicates, SPEC),
        cleaning.cleaning_audit(prov, cleaning.clean_table(prov, SPEC), "t"),
    ):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)
    forest = plan(iforest.flag_isolation_forest(series, G, METRICS))
    assert "Cartesian" not in forest and "NestedLoop" not in forest


def test_top_k_per_group_is_cut_before_the_shuffle(series):
    flagged = outliers.flag_univariate(series, G, METRICS)
    assert "WindowGroupLimit" in plan(reports.peak_labels(flagged, G, "cases_total"))
    summary = reports.outlier_summary(flagged, G, outliers.flag_columns(METRICS))
    top = reports.top_groups(summary, G, "cases_total__is_mad")
    assert "TakeOrderedAndProject" in plan(top)


def test_rows_are_drawn_before_they_are_shuffled_to_the_trees(series):
    lines = plan(iforest.iforest_fit(series, G, METRICS)).splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange hash" in line]
    # By group for its size, and once with the drawn rows; no join.
    assert len(exchanges) == 2 and "Join" not in "".join(lines)
    drawn = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    assert exchanges[0] < drawn < exchanges[1]


def test_text_keys_are_hashed_and_not_sorted_before_the_shuffle(spark, prov):
    spec = next(s for s in SURVEILLANCE if s.name == "iras_weekly_prov")
    wide = prov.withColumn("ubigeo", F.col("ubigeo").cast("string"))
    wide = wide.withColumns({c: F.lit(1).cast("bigint") for c in spec.metrics if c not in wide.columns})
    lines = plan(cleaning.clean_table(wide, spec)).splitlines()
    last = max(i for i, line in enumerate(lines) if "Exchange hash" in line)
    assert "HashAggregate" in lines[last + 1] and "partial_max" in lines[last + 1]
    # Raw rows: no sort below the first shuffle; what is sorted has been collapsed.
    assert not any("Sort" in line for line in lines[last:])
    assert "HashAggregate" in lines[last - 1]
