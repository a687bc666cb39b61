"""Tiny literal tables."""

from __future__ import annotations

import datetime

from weekwatch.specs import DEATHS, HOSP, TableSpec

SPEC = TableSpec(
    name="tiny",
    group_keys=("department",),
    key_cols=("ubigeo", "week_start"),
    hosp=HOSP,
    deaths=DEATHS,
    natural_key=("department", "week_start"),
    metrics=("cases_total", *HOSP.columns, *DEATHS.columns),
    passthrough=("ubigeo", "ano", "semana"),
    tie_break="ubigeo",
    detect_metrics=("cases_total", "hosp_total", "deaths_total"),
    silence_keys=("department", "province"),
)
SCHEMA = (
    "ubigeo int, department string, province string, ano int, semana int, week_start date, "
    "cases_total bigint, hosp_under5 bigint, hosp_60plus bigint, hosp_total bigint, "
    "deaths_under5 bigint, deaths_60plus bigint, deaths_total bigint"
)
NAMES = [column.split()[0] for column in SCHEMA.split(", ")]
ORDINARY = {
    "ubigeo": 1,
    "department": "A",
    "province": "A1",
    "ano": 2000,
    "semana": 1,
    "week_start": datetime.date(2000, 1, 3),
    "cases_total": 10,
    "hosp_under5": 1,
    "hosp_60plus": 1,
    "hosp_total": 4,
    "deaths_under5": 0,
    "deaths_60plus": 0,
    "deaths_total": 1,
}


def table(spark, *changes: dict):
    """One row per dict, ordinary except for what the dict says."""
    rows = [[{**ORDINARY, **c}[n] for n in NAMES] for c in changes]
    return spark.createDataFrame(rows, SCHEMA)


def monday(week: int) -> datetime.date:
    return datetime.date(2000, 1, 3) + datetime.timedelta(days=7 * week)


def weekly(spark, values, group="A", metric="cases_total"):
    """A series of one group with the given values, one per week."""
    rows = [(group, monday(i), 2000 + i // 52, i % 52 + 1, v) for i, v in enumerate(values)]
    kind = "double" if any(isinstance(v, float) for v in values) else "bigint"
    return spark.createDataFrame(
        rows, f"department string, week_start date, ano int, semana int, {metric} {kind}"
    )
