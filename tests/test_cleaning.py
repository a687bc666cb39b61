from frames import SPEC, monday, table
from weekwatch.operators.cleaning import (
    clamp_hosp_gt_cases,
    clean_table,
    cleaning_audit,
    deduplicate,
    flag_deaths_gt_hosp,
)


def test_largest_value_of_each_metric_on_its_own(spark):
    rows = table(spark, {"cases_total": 5, "hosp_total": 4}, {"cases_total": 3, "hosp_total": None})
    out = deduplicate(rows, SPEC.natural_key, SPEC.metrics).collect()
    assert len(out) == 1 and (out[0]["cases_total"], out[0]["hosp_total"]) == (5, 4)


def test_passthrough_values_come_from_one_row(spark):
    rows = table(spark, {"ubigeo": 3, "ano": 1}, {"ubigeo": 2, "ano": 9}, {"ubigeo": 4, "ano": 5})
    for tie_break in ("ubigeo", None):
        out = deduplicate(rows, SPEC.natural_key, [], ["ubigeo", "ano"], tie_break).first()
        assert (out["ubigeo"], out["ano"]) == (2, 9)


def test_a_missing_tie_break_loses_nothing(spark):
    rows = table(spark, {"ubigeo": None, "ano": 2020, "semana": 2}, {"ubigeo": None, "ano": 2020, "semana": 2})
    out = deduplicate(rows, SPEC.natural_key, ["cases_total"], ["ubigeo", "ano", "semana"], "ubigeo").first()
    assert (out["ubigeo"], out["ano"], out["semana"]) == (None, 2020, 2)


def test_equal_tie_breaks_do_not_depend_on_row_order(spark):
    rows = [{"ubigeo": 7, "ano": 2020, "semana": 1}, {"ubigeo": 7, "ano": 2019, "semana": 53},
            {"ubigeo": None, "ano": 2018, "semana": 9}, {"ubigeo": 7, "ano": None, "semana": 2}]
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [1, 3, 0, 2]):
        frame = table(spark, *(rows[i] for i in order))
        for n in (1, 7, 64):
            out = deduplicate(frame.repartition(n), SPEC.natural_key, [], ["ubigeo", "ano", "semana"], "ubigeo")
            assert [(r["ubigeo"], r["ano"], r["semana"]) for r in out.collect()] == [(7, 2019, 53)]


def test_null_keys_form_a_group(spark):
    rows = table(spark, {"department": None}, {"department": None}, {})
    assert deduplicate(rows, SPEC.natural_key, SPEC.metrics).count() == 2


def clamped(spark, cases, hosp):
    row = clamp_hosp_gt_cases(table(spark, {"cases_total": cases, "hosp_total": hosp})).first()
    return row["cases_total"], row["flag_hosp_corrected"]


def test_clamp_edges(spark):
    assert clamped(spark, None, 5) == (5, True)
    assert clamped(spark, -1, None) == (None, True)
    assert clamped(spark, 3, 3) == (3, False)
    assert clamped(spark, 3, 7) == (7, True)


def test_deaths_are_flagged_and_kept(spark):
    rows = table(spark, {"deaths_total": 5}, {"deaths_total": 5, "hosp_total": None}, {})
    flags = [r["flag_death_no_hosp"] for r in flag_deaths_gt_hosp(rows).collect()]
    assert sorted(flags) == [False, True, True]


def test_death_flag_looks_at_the_admissions_before_the_clamp(spark):
    out = clean_table(table(spark, {"cases_total": 1, "deaths_total": 5}), SPEC).first()
    assert (out["flag_death_no_hosp"], out["flag_hosp_corrected"], out["cases_total"]) == (True, True, 4)


def test_audit(spark):
    rows = table(spark, {}, {}, {"week_start": monday(1), "hosp_total": 11}, {"week_start": monday(2)})
    audit = cleaning_audit(rows, clean_table(rows, SPEC), "tiny").first().asDict()
    assert audit == {
        "name": "tiny",
        "in": 4,
        "out": 3,
        "dups_removed": 1,
        "flag_death_no_hosp": 0,
        "flag_hosp_corrected": 1,
    }
