import math
import statistics

import pytest

from compare import spark_rows
from frames import monday, weekly
from weekwatch.functions import group_quantiles
from weekwatch.operators import outlier_reports as reports
from weekwatch.operators import outliers as o

G, M = ["department"], "cases_total"


def column(df, name):
    return [r[name] for r in df.orderBy("week_start").collect()]


def quartiles(spark, values, mode):
    df = group_quantiles(weekly(spark, values), G, [M], {"lo_": 0.25, "hi_": 0.75}, mode)
    row = df.first()
    return row[f"lo_{M}"], row[f"hi_{M}"]


def test_quantile_modes(spark):
    values = [*range(1, 8), 100, None, *range(10, 17)]
    assert quartiles(spark, values, "nearest") == (5, 14)
    assert quartiles(spark, values, "linear")[0] == 4.5
    assert quartiles(spark, values, "approx")[0] in (4, 5)
    with pytest.raises(ValueError):
        quartiles(spark, values, "other")


@pytest.mark.parametrize("n", range(1, 14))
def test_nearest_rank_for_every_length(spark, n):
    ranks = [math.floor((n - 1) * q + 0.5) for q in (0.25, 0.75)]
    assert quartiles(spark, list(range(n)), "nearest") == tuple(ranks)


def test_iqr_fences_are_strict(spark):
    # Quartiles 2 and 6 put the upper fence at 12.
    df = o.flag_iqr(weekly(spark, [0, 1, 2, 3, 4, 5, 6, 12, 13]), G, M)
    assert df.first()[f"{M}__iqr_high"] == 12.0
    assert column(df, f"{M}__is_iqr") == [False] * 8 + [True]


def test_zero_iqr_flags_every_nonzero_but_mad_none(spark):
    series = weekly(spark, [0] * 20 + [1])
    assert column(o.flag_iqr(series, G, M), f"{M}__is_iqr") == [False] * 20 + [True]
    mad = o.flag_mad(series, G, M)
    assert set(column(mad, f"{M}__mad_score")) == set(column(mad, f"{M}__is_mad")) == {None}


def test_mad_score(spark):
    values = [1, 2, 3, 4, 100]
    scores = column(o.flag_mad(weekly(spark, values), G, M), f"{M}__mad_score")
    assert scores == pytest.approx([0.6745 * (v - 3) / 1 for v in values])
    assert column(o.flag_mad(weekly(spark, values), G, M), f"{M}__is_mad")[-1] is True


def test_seasonal_compares_the_same_week(spark):
    values = [0] * 52 * 5
    for year, v in enumerate([10, 11, 12, 13, 90]):
        values[year * 52 + 3] = v
    df = o.flag_seasonal(weekly(spark, values), G, M)
    hits = [i for i, hit in enumerate(column(df, f"{M}__is_seas")) if hit]
    assert hits == [4 * 52 + 3]


def test_rolling_frame():
    assert o.rolling_frame(13) == (-6, 6)
    assert o.rolling_frame(4) == (-2, 1)


def rolling_by_hand(values, window=13):
    low, high = o.rolling_frame(window)
    out = []
    for i, v in enumerate(values):
        seen = [x for x in values[max(0, i + low) : i + high + 1] if x is not None]
        spread = statistics.stdev(seen) if len(seen) > 1 else 0
        if v is None or len(seen) < max(3, window // 2) or not spread:
            out.append(None)
        else:
            out.append((v - statistics.mean(seen)) / spread)
    return out


@pytest.mark.parametrize("window", [13, 4])
def test_rolling_scores(spark, window):
    values = [(i * 37) % 11 if i % 9 else None for i in range(60)] + [5] * 20
    scores = column(o.flag_rolling_z(weekly(spark, values), G, M, window=window), f"{M}__roll_z")
    for ours, theirs in zip(scores, rolling_by_hand(values, window), strict=True):
        assert (ours is None) == (theirs is None)
        assert ours is None or ours == pytest.approx(theirs)


def test_rolling_known_behaviour(spark):
    middle = o.flag_rolling_z(weekly(spark, [0] * 20 + [1] + [0] * 20), G, M)
    assert column(middle, f"{M}__roll_z")[20] == pytest.approx(3.328, abs=1e-3)
    assert column(middle, f"{M}__is_roll")[20] is True
    first = o.flag_rolling_z(weekly(spark, [1] + [0] * 20), G, M)
    assert column(first, f"{M}__is_roll")[0] is False
    few = o.flag_rolling_z(weekly(spark, [1, None, 2, 3, 4, None]), G, M)
    assert set(column(few, f"{M}__roll_z")) == {None}


def test_series_takes_the_largest_and_keeps_null_groups(spark):
    df = spark.createDataFrame(
        [("A", monday(0), 1, 5), ("A", monday(0), 7, 2), (None, monday(0), 1, 1)],
        "department string, week_start date, m int, ano int",
    )
    rows = o.weekly_series(df, G, "week_start", ["m"], ["ano"]).collect()
    assert {(r["department"], r["m"], r["ano"]) for r in rows} == {("A", 7, 5), (None, 1, 1)}


def test_null_group_is_scored_like_any_other(spark):
    values = [0, 1, 2, 3, 4, 5, 6, 12, 13]
    named = o.flag_univariate(weekly(spark, values), G, [M]).drop("department")
    unnamed = o.flag_univariate(weekly(spark, values, group=None), G, [M]).drop("department")
    assert spark_rows(named) == spark_rows(unnamed)


def test_reports(spark):
    series = weekly(spark, [0, 1, 2, 3, 4, 5, 6, 12, 13]).unionByName(
        weekly(spark, [0, 1, 2, 3, 4, 5, 6, 12, 13, 14], group="B")
    )
    flags = o.flag_columns([M])
    flagged = o.flag_univariate(series, G, [M])
    summary = reports.outlier_summary(flagged, G, flags)
    counts = {r["department"]: (r[f"{M}__is_iqr"], r["n_obs"]) for r in summary.collect()}
    assert counts == {"A": (1, 9), "B": (0, 10)}
    detail = reports.outlier_detail(flagged, [*G, "week_start"], [M], flags).collect()
    assert [(r["department"], r[M]) for r in detail if r[f"{M}__is_iqr"]] == [("A", 13)]
    totals = reports.method_totals(summary, flags).collect()
    assert (totals[0]["method"], totals[0]["flagged"], totals[0]["pct"]) == (f"{M}__is_iqr", 1, 5.26)
    top = reports.top_groups(summary, G, f"{M}__is_iqr", 1).collect()
    assert [r["department"] for r in top] == ["A"]


def test_peaks_are_the_highest_hits_earliest_first(spark):
    values = [0, 0, 1, 1, 2, 2, 1, 1, 0, 0] * 4
    for place, v in ((5, 50), (15, 60), (25, 60), (35, 40)):
        values[place] = v
    flagged = o.flag_univariate(weekly(spark, values), G, [M])
    peaks = reports.peak_labels(flagged, G, M, k=3).filter("method = 'MAD'").orderBy("place")
    assert [(r["place"], r["week_start"], r[M]) for r in peaks.collect()] == [
        (1, monday(15), 60),
        (2, monday(25), 60),
        (3, monday(5), 50),
    ]
    assert reports.peak_labels(flagged, G, M, top_n=0).count() == 0


def test_method_series_is_ordered(spark):
    flagged = o.flag_univariate(weekly(spark, [3, 1, 2]), G, [M]).repartition(3)
    out = reports.method_series(flagged, flagged["department"] == "A", M)
    assert out.columns == ["week_start", M, "IQR", "MAD", "Rolling", "Seasonal"]
    assert [r[M] for r in out.collect()] == [3, 1, 2]
