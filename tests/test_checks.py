from frames import SPEC, table
from weekwatch.operators.checks import add_flags, flag_names, flag_totals, issue_columns, issue_rows


def flags(spark, **changes):
    row = add_flags(table(spark, changes), SPEC).first().asDict()
    return {n: row[n] for n in flag_names(SPEC)}


def true_flags(spark, **changes):
    return {n for n, v in flags(spark, **changes).items() if v}


def test_there_are_twenty_checks(spark):
    assert len(flag_names(SPEC)) == 20


def test_ordinary_row_has_no_flag(spark):
    assert true_flags(spark) == set()


def test_missing_measures_are_null_and_nothing_else(spark):
    missing = dict.fromkeys((*SPEC.measure_cols, "cases_total"))
    assert true_flags(spark, **missing) == {f"_chk_null__{c}" for c in SPEC.measure_cols}


def test_negative(spark):
    assert true_flags(spark, hosp_under5=-1) == {"_chk_neg__hosp_under5"}


def test_strata(spark):
    assert true_flags(spark, hosp_under5=3, hosp_60plus=2) == {"_chk_strata__hosp"}
    assert true_flags(spark, hosp_under5=2, hosp_60plus=2) == set()
    assert true_flags(spark, deaths_under5=2) == {"_chk_strata__deaths"}


def test_logic(spark):
    assert true_flags(spark, hosp_total=11) == {"_chk_logic__hosp_gt_cases"}
    assert true_flags(spark, deaths_total=11) == {
        "_chk_logic__deaths_gt_cases",
        "_chk_logic__deaths_gt_hosp",
    }


def test_ranges_and_missing_year(spark):
    assert true_flags(spark, ano=1998) == {"_chk_range__year"}
    assert true_flags(spark, ano=2027, semana=0) == {"_chk_range__year", "_chk_range__week"}
    assert true_flags(spark, ano=1999, semana=53) == set()
    assert flags(spark, ano=None)["_chk_range__year"] is None


def test_silence(spark):
    quiet = {"hosp_total": None, "deaths_total": 0, "hosp_under5": 0, "hosp_60plus": 0}
    assert "_chk_silence__no_hosp_no_death_with_cases" in true_flags(spark, **quiet)
    assert "_chk_silence__no_hosp_no_death_with_cases" not in true_flags(
        spark, **quiet, cases_total=0
    )


def test_totals_ignore_null_flags_and_empty_tables_give_zero(spark):
    rows = table(spark, {"ano": None}, {"ano": 1990})
    totals = flag_totals(rows, SPEC).first()
    assert totals["_chk_range__year"] == 1 and totals["n_rows"] == 2
    empty = flag_totals(rows.limit(0), SPEC).first()
    assert set(empty.asDict().values()) == {0}


def test_issue_rows_keep_only_true_and_name_columns_once(spark):
    rows = issue_rows(table(spark, {"ano": None}, {"ano": 1990}, {}), SPEC)
    assert [r["_chk_range__year"] for r in rows.collect()] == [True]
    assert len(set(rows.columns)) == len(rows.columns)
    shared = SPEC.with_(key_cols=("department", "week_start"))
    assert issue_columns(shared).count("department") == 1
