"""What an operator needs to know about a table, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Strata:
    """A measure that is reported as parts and as a total of those parts."""

    label: str
    parts: tuple[str, ...]
    total: str

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.parts, self.total)


@dataclass(frozen=True)
class TableSpec:
    """Roles of the columns of one table of counts per region and week."""

    name: str
    group_keys: tuple[str, ...]
    key_cols: tuple[str, ...]
    hosp: Strata
    deaths: Strata
    cases_col: str = "cases_total"
    year_col: str = "ano"
    week_col: str = "semana"
    date_col: str = "week_start"
    year_bounds: tuple[int, int] = (1999, 2026)
    week_bounds: tuple[int, int] = (1, 53)
    #: One row per ``natural_key`` is left by cleaning; empty: not cleaned.
    natural_key: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    passthrough: tuple[str, ...] = ()
    #: Column that picks the row whose pass-through values are kept.
    tie_break: str | None = None
    #: Metrics the outlier detectors look at; empty: not analysed.
    detect_metrics: tuple[str, ...] = ()
    #: Keys of the under-reporting table; empty: not reported.
    silence_keys: tuple[str, ...] = ()
    #: Name of the stored table, when it is not ``name``.
    stored_as: str | None = None
    #: Name of the detector reports, when it is not ``name``.
    detect_name: str | None = None

    @property
    def file_name(self) -> str:
        return f"{self.stored_as or self.name}.parquet"

    @property
    def measure_cols(self) -> tuple[str, ...]:
        return (*self.hosp.columns, *self.deaths.columns)

    def with_(self, **changes) -> TableSpec:
        return replace(self, **changes)


# Columns of the surveillance tables.
HOSP = Strata("hosp", ("hosp_under5", "hosp_60plus"), "hosp_total")
DEATHS = Strata("deaths", ("deaths_under5", "deaths_60plus"), "deaths_total")

_TOTALS = ("cases_total", "hosp_total", "deaths_total")
_RESPIRATORY = (*_TOTALS, "pneumonia_under5", "pneumonia_60plus", *HOSP.parts, *DEATHS.parts)
_PNEUMONIA = (
    "cases_under5",
    "cases_60plus",
    "cases_total",
    "hosp_under5",
    "hosp_60plus",
    "hosp_total",
    "deaths_under5",
    "deaths_60plus",
    "deaths_total",
    "incidence_cases_under5",
    "incidence_cases_60plus",
    "incidence_cases_total",
    "incidence_hosp_under5",
    "incidence_hosp_60plus",
    "incidence_hosp_total",
    "incidence_deaths_under5",
    "incidence_deaths_60plus",
    "incidence_deaths_total",
)
_CARRIED = ("ubigeo", "ano", "semana")


def _weekly(name: str, level: tuple[str, ...], metrics: tuple[str, ...], **roles) -> TableSpec:
    return TableSpec(
        name=name,
        group_keys=("department",),
        key_cols=("ubigeo", "week_start"),
        hosp=HOSP,
        deaths=DEATHS,
        natural_key=(*level, "week_start"),
        metrics=metrics,
        passthrough=_CARRIED,
        tie_break="ubigeo",
        **roles,
    )


# The surveillance tables, their keys and their metrics.
SURVEILLANCE: tuple[TableSpec, ...] = (
    TableSpec(
        name="iras_raw",
        stored_as="iras_data_raw",
        group_keys=("department",),
        key_cols=("ubigeo", "ano", "semana"),
        hosp=HOSP,
        deaths=DEATHS,
    ),
    _weekly(
        "iras_weekly_dept",
        ("department",),
        _RESPIRATORY,
        detect_metrics=_TOTALS,
        detect_name="iras_dept",
    ),
    _weekly(
        "iras_weekly_prov",
        ("department", "province"),
        _RESPIRATORY,
        silence_keys=("department", "province"),
    ),
    _weekly(
        "pneumonia_dept",
        ("department",),
        _PNEUMONIA,
        stored_as="pneumonia_weekly_incidence_dept",
        detect_metrics=(*_TOTALS, "incidence_cases_total", "incidence_hosp_total"),
    ),
    _weekly(
        "pneumonia_prov",
        ("department", "province"),
        _PNEUMONIA,
        stored_as="pneumonia_weekly_incidence_prov",
    ),
)
