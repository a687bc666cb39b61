import pytest

from frames import SPEC, table
from weekwatch.operators import silence

KEYS = ["department", "province"]
QUIET = {"hosp_total": 0, "deaths_total": None}


def slope(spark, *points):
    df = spark.createDataFrame([("A", y, float(p)) for y, p in points], "g string, ano int, pct double")
    return silence.trend_slope(df, ["g"], "ano").first()["slope_pct_per_year"]


def test_slope_edges(spark):
    assert slope(spark, (2000, 5)) == 0.0
    assert slope(spark, (2000, 5), (2000, 9)) == 0.0
    assert slope(spark, (2000, 1), (2001, 3), (2002, 4)) == 1.5


def test_report_agrees_with_its_parts(spark):
    rows = table(
        spark,
        *[QUIET] * 2,
        {},
        {**QUIET, "ano": 2001},
        {"ano": 2001, "province": "A2"},
        {**QUIET, "department": None},
    )
    report = {(r[0], r[1]): r for r in silence.silence_report(rows, KEYS, SPEC).collect()}
    rates = {(r[0], r[1]): r for r in silence.silence_rate(rows, KEYS, SPEC).collect()}
    for key, row in rates.items():
        assert (report[key]["pct_silence"], report[key]["n_obs"]) == (row["pct_silence"], row["n_obs"])
    assert report[("A", "A1")]["pct_silence"] == 75.0
    assert report[("A", "A1")]["slope_pct_per_year"] == pytest.approx(33.3333)
    assert report[("A", "A2")]["slope_pct_per_year"] == 0.0
    # A missing region name cannot be matched, so it has no trend.
    assert report[(None, "A1")]["slope_pct_per_year"] is None


def test_report_is_ordered_and_top_is_its_head(spark):
    rows = table(spark, {}, {**QUIET, "province": "A3"}, {**QUIET, "province": "A2"})
    report = silence.silence_report(rows, KEYS, SPEC)
    assert [r["province"] for r in report.collect()] == ["A2", "A3", "A1"]
    assert [r["province"] for r in silence.top_silent(report, KEYS, 1).collect()] == ["A2"]


def test_reading(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.0,), (None,)], "slope_pct_per_year double")
    reading = [r["trend"] for r in silence.trend_reading(df).collect()]
    assert reading == ["worsens", "improves", "steady", None]
