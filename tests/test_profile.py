import datetime

from compare import spark_rows
from frames import SPEC, monday, table
from weekwatch.operators import profile
from weekwatch.operators.checks import flag_totals


def test_null_is_a_key_value(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, 3)], "a int, b int")
    assert profile.duplicate_count(rows, ["a", "b"]).first()["duplicados"] == 1
    assert profile.duplicate_count(rows.limit(0), ["a", "b"]).first()["duplicados"] == 0


def expected_weeks(spark, *days):
    start = datetime.date(2000, 1, 3)
    rows = [("A", start + datetime.timedelta(days=d)) for d in days]
    df = spark.createDataFrame(rows, "g string, d date")
    return profile.temporal_coverage(df, ["g"], "d").first()


def test_expected_weeks(spark):
    assert expected_weeks(spark, 0)["n_esperado"] == 1
    assert expected_weeks(spark, 0, 13)["n_esperado"] == 2
    assert expected_weeks(spark, 0, 14)["n_esperado"] == 3
    row = expected_weeks(spark, 0, 0, 14)
    assert (row["n_observado"], row["pct_cobertura"], row["n_faltantes"]) == (2, 66.67, 1)


def test_a_missing_date_counts_as_one_value(spark):
    df = spark.createDataFrame([("A", monday(0)), ("A", None), ("A", None)], "g string, d date")
    assert profile.temporal_coverage(df, ["g"], "d").first()["n_observado"] == 2


def test_low_coverage(spark):
    df = spark.createDataFrame([("A", 95.0), ("B", 94.99)], "g string, pct_cobertura double")
    assert [r["g"] for r in profile.low_coverage(df).collect()] == ["B"]


def test_null_profile_orders_by_count_then_position(spark):
    df = spark.createDataFrame([(1, None, None, 2), (1, None, 3, None)], "d int, c int, b int, a int")
    rows = [tuple(r) for r in profile.null_profile(df).collect()]
    assert rows == [("c", 2, 100.0), ("b", 1, 50.0), ("a", 1, 50.0), ("d", 0, 0.0)]
    top = profile.top_null_columns(profile.null_profile(df), df.columns, 2)
    assert [r["column"] for r in top.collect()] == ["c", "b"]


def test_null_profile_of_no_rows(spark):
    df = spark.createDataFrame([], "a int, b int")
    assert [tuple(r) for r in profile.null_profile(df).collect()] == [("a", 0, 0.0), ("b", 0, 0.0)]


def test_null_share_per_group_keeps_the_null_group(spark):
    df = spark.createDataFrame([("x", None), ("x", 1), ("x", 2), (None, None)], "g string, a int")
    rows = {r["g"]: r["a"] for r in profile.null_pct_by(df, ["a"], ["g"]).collect()}
    assert rows == {"x": 33.33, None: 100.0}


def test_cells_give_the_same_as_the_table(prov):
    from fixtures.weekly import WEEKLY_PROV as spec

    cells = profile.integrity_cells(prov, spec)
    cols = spec.measure_cols
    pairs = [
        (profile.flag_totals_from_cells(cells, spec), flag_totals(prov, spec)),
        (profile.null_profile_from_cells(cells, prov.columns), profile.null_profile(prov)),
        (
            profile.null_pct_by_from_cells(cells, cols, ["department"]),
            profile.null_pct_by(prov, cols, ["department"]),
        ),
        (profile.null_pct_by_from_cells(cells, cols, ["ano"]), profile.null_pct_by(prov, cols, ["ano"])),
        (
            profile.temporal_coverage(cells, ["department"], "week_start"),
            profile.temporal_coverage(prov, ["department"], "week_start"),
        ),
    ]
    for from_cells, direct in pairs:
        assert spark_rows(from_cells) == spark_rows(direct)


def test_overview_and_rankings(spark):
    rows = table(spark, {}, {}, {"ano": 1990, "ubigeo": 2})
    totals, duplicates = flag_totals(rows, SPEC), profile.duplicate_count(rows, SPEC.key_cols)
    overview = profile.integrity_overview([profile.table_overview(totals, duplicates, SPEC)] * 2)
    assert [(r["tabla"], r["filas"], r["duplicados"]) for r in overview.collect()] == [("tiny", 3, 1)] * 2
    assert overview.first()["_chk_range__year_pct"] == 33.333
    issues = profile.issue_ranking(totals, duplicates, SPEC).collect()
    assert [(r["check"], r["count"]) for r in issues] == [("range__year", 1), ("duplicates", 1)]
    ranked = profile.check_ranking(totals, SPEC).collect()
    assert len(ranked) == 20
    assert (ranked[0]["check"], ranked[0]["severe"], ranked[1]["severe"]) == (
        "_chk_range__year",
        True,
        False,
    )
    empty = profile.table_overview(
        flag_totals(rows.limit(0), SPEC), profile.duplicate_count(rows.limit(0), SPEC.key_cols), SPEC
    )
    assert empty.first()["_chk_range__year_pct"] == 0.0


def test_odd_column_names(spark):
    names = ["a b", "it's", "back\\slash"]
    df = spark.createDataFrame([(None, 1, 2)], "a int, b int, c int").toDF(*names)
    rows = [tuple(r) for r in null_rows(df)]
    assert rows == [("a b", 1), ("it's", 0), ("back\\slash", 0)]


def null_rows(df):
    return profile.null_profile(df).select("column", "nulls").collect()
