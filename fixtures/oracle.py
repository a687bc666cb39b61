"""The registered queries in plain SQL, for the engine that checks them.

Written separately from the Spark side: window functions and sorted lists here
where Spark uses aggregates, and the other way round.
"""

from __future__ import annotations

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
HOSP = ["hosp_under5", "hosp_60plus", "hosp_total"]
DEATHS = ["deaths_under5", "deaths_60plus", "deaths_total"]
MEASURES = ["cases_under5", "cases_60plus", "cases_total", *HOSP, *DEATHS]
INCIDENCES = [f"incidence_{m}" for m in MEASURES]
PROV_COLUMNS = ["ubigeo", "department", "province", "ano", "semana", "week_start", *MEASURES, *INCIDENCES]
DETECT = ["cases_total", "hosp_total", "deaths_total"]
METHODS = ["iqr", "mad", "roll", "seas"]

_AGES = {"under5": "l_quantity <= 10", "60plus": "l_quantity >= 41", "total": "true"}
_KINDS = {
    "cases": "true",
    "hosp": "l_returnflag = 'R'",
    "deaths": "l_returnflag = 'R' and l_discount >= 0.09",
}
_COUNTED = ",\n    ".join(
    f"count(*) filter (where {kind} and {age}) as {k}_{a}"
    for k, kind in _KINDS.items()
    for a, age in _AGES.items()
)
_RATES = ",\n    ".join(f"{m} * 100000.0 / people as incidence_{m}" for m in MEASURES)
_KEPT = ", ".join(
    m for m in MEASURES if m not in ("hosp_total", "deaths_total", "hosp_under5", "deaths_under5")
)

CELLS = f"""
people as (
  select c_nationkey, c_mktsegment, count(*) as people from customer group by 1, 2),
counted as (
  select c_nationkey, c_mktsegment, cast(date_trunc('week', l_shipdate) as date) as week_start,
    {_COUNTED}
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  group by 1, 2, 3),
located as (
  select counted.*, people, n_name as department, c_mktsegment as province,
    n_nationkey * 5 + case c_mktsegment when 'AUTOMOBILE' then 0 when 'BUILDING' then 1
      when 'FURNITURE' then 2 when 'HOUSEHOLD' then 3 else 4 end as ubigeo,
    date_diff('day', date '1995-01-02', week_start) // 7 as week_no
  from counted join people using (c_nationkey, c_mktsegment)
  join nation on c_nationkey = n_nationkey),
numbered as (select *, ubigeo * 367 + week_no as cell from located),
cells as (
  select ubigeo, department, province, week_start, people, {_KEPT},
    cast(case when cell % 107 = 0 then 1990 else extract(year from week_start) end as int) as ano,
    cast(case when cell % 103 = 0 then 54 else weekofyear(week_start) end as int) as semana,
    case when cell % 97 = 0 then null when cell % 83 = 0 then cases_total + 2
      else hosp_total end as hosp_total,
    case when cell % 89 = 0 then hosp_total + 1 else deaths_total end as deaths_total,
    case when cell % 101 = 0 then -1 else hosp_under5 end as hosp_under5,
    case when cell % 109 = 0 then deaths_total + 1 else deaths_under5 end as deaths_under5,
    {_RATES}
  from numbered)"""

PROV = f"""{CELLS},
prov as (select {', '.join(PROV_COLUMNS)} from cells cross join range(3) as copies(i))"""

DEPT = f"""{CELLS},
dept as (
  select department, week_start,
    cast(extract(year from week_start) as int) as ano, cast(weekofyear(week_start) as int) as semana,
    {', '.join(f'cast(sum({m}) as bigint) as {m}' for m in MEASURES)}
  from cells group by department, week_start)"""


def _positive_zero(value: str) -> str:
    """Rounding a small negative number here leaves a negative zero."""
    return f"case when {value} = 0 then cast(0 as double) else {value} end"


def _zero(c: str) -> str:
    return f"coalesce({c}, 0)"


_SILENT = (
    "coalesce(cases_total, 0) > 0 and coalesce(hosp_total, 0) = 0 and coalesce(deaths_total, 0) = 0"
)
CHECKS: dict[str, str] = {
    **{f"_chk_null__{c}": f"{c} is null" for c in HOSP + DEATHS},
    **{f"_chk_neg__{c}": f"{_zero(c)} < 0" for c in HOSP + DEATHS},
    "_chk_strata__hosp": f"{_zero(HOSP[0])} + {_zero(HOSP[1])} > {_zero(HOSP[2])}",
    "_chk_strata__deaths": f"{_zero(DEATHS[0])} + {_zero(DEATHS[1])} > {_zero(DEATHS[2])}",
    "_chk_logic__hosp_gt_cases": f"{_zero('hosp_total')} > {_zero('cases_total')}",
    "_chk_logic__deaths_gt_cases": f"{_zero('deaths_total')} > {_zero('cases_total')}",
    "_chk_logic__deaths_gt_hosp": f"{_zero('deaths_total')} > {_zero('hosp_total')}",
    "_chk_range__year": "ano < 1995 or ano > 2001",
    "_chk_range__week": "semana < 1 or semana > 53",
    "_chk_silence__no_hosp_no_death_with_cases": _SILENT,
}
_FLAGS = ", ".join(f"({e}) as {n}" for n, e in CHECKS.items())
FLAGGED = f"{PROV},\nflagged as (select *, {_FLAGS} from prov)"
_SUMS = ", ".join(f"count(*) filter (where {n}) as {n}" for n in CHECKS)
TOTALS = f"{FLAGGED},\ntotals as (select count(*) as n_rows, {_SUMS} from flagged)"
_DUPLICATES = "(select count(*) - count(distinct (ubigeo, week_start)) from prov)"


def _long(names: list[str], table: str, label: str, value: str) -> str:
    rows = " union all ".join(
        f"select {i} as position, '{n}' as {label}, {n} as {value}, n_rows from {table}"
        for i, n in enumerate(names)
    )
    return f"({rows})"


def _coverage(keys: str) -> str:
    return f"""with {PROV},
spans as (
  select {keys}, min(week_start) as date_min, max(week_start) as date_max,
    count(distinct week_start) as n_observado
  from prov group by {keys}),
expected as (
  select *, date_diff('day', date_min, date_max) // 7 + 1 as n_esperado from spans)
select {keys}, date_min, date_max, n_observado, n_esperado,
  round_even(n_observado / n_esperado * 100, 2) as pct_cobertura,
  n_esperado - n_observado as n_faltantes
from expected"""


def _null_shares(key: str) -> str:
    shares = ", ".join(
        f"round_even(count(*) filter (where {c} is null) / count(*) * 100, 2) as {c}"
        for c in HOSP + DEATHS
    )
    return f"with {PROV} select {key}, {shares} from prov group by {key}"


def _dedup(keys: str) -> str:
    largest = ", ".join(f"max({m}) as {m}" for m in MEASURES + INCIDENCES)
    kept = ", ".join(
        f"list({c} order by ubigeo nulls last, ano nulls last, semana nulls last)[1] as {c}"
        for c in ("ubigeo", "ano", "semana")
    )
    return f"{PROV},\ndedup as (select {keys}, {largest}, {kept} from prov group by {keys})"


_DEATH_FLAG = "coalesce(deaths_total, 0) > coalesce(hosp_total, 0) as flag_death_no_hosp"
_CLAMPED = """* replace (
    case when coalesce(hosp_total, 0) > coalesce(cases_total, 0)
      then hosp_total else cases_total end as cases_total),
  coalesce(hosp_total, 0) > coalesce(cases_total, 0) as flag_hosp_corrected"""
DEDUP_PROV = _dedup("department, province, week_start")
CLEAN = f"{DEDUP_PROV},\nclean as (select {_CLAMPED}, {_DEATH_FLAG} from dedup)"

_REGION = "department, province"
SILENCE = f"""{PROV},
marked as (select department, province, ano, case when {_SILENT} then 1.0 else 0.0 end as quiet from prov),
rate as (
  select {_REGION}, round_even(avg(quiet) * 100, 3) as pct_silence, count(*) as n_obs
  from marked group by {_REGION}),
yearly as (select {_REGION}, ano, sum(quiet) / count(*) * 100 as pct from marked group by {_REGION}, ano),
centred as (
  select *, ano - avg(ano) over (partition by {_REGION}) as x,
    pct - avg(pct) over (partition by {_REGION}) as y from yearly),
fitted as (
  select {_REGION}, round_even(case when sum(x * x) = 0 then 0.0 else sum(x * y) / sum(x * x) end, 4)
    as fitted
  from centred group by {_REGION}),
slope as (select {_REGION}, {_positive_zero('fitted')} as slope_pct_per_year from fitted),
report as (
  select department, province, pct_silence, n_obs, slope_pct_per_year
  from rate left join slope using (department, province))"""


def _quartile(m: str, q: float) -> str:
    values = f"list_sort(list({m}) filter (where {m} is not null))"
    return f"{values}[cast(floor((count({m}) - 1) * {q} + 0.5) as int) + 1]"


def _stats(metrics: list[str]) -> str:
    """Per group and per group and season: quartiles, medians, deviations."""
    quartiles = ", ".join(
        f"{_quartile(m, 0.25)} as {m}_q1, {_quartile(m, 0.75)} as {m}_q3, median({m}) as {m}_med"
        for m in metrics
    )
    spreads = ", ".join(f"median(abs({m} - {m}_med)) as {m}_mad" for m in metrics)
    seasons = ", ".join(f"median({m}) as {m}_smed" for m in metrics)
    season_spreads = ", ".join(f"median(abs({m} - {m}_smed)) as {m}_smad" for m in metrics)
    frame = "partition by department order by week_start rows between 6 preceding and 6 following"
    rolling = ", ".join(
        f"count({m}) over w as {m}_n, avg({m}) over w as {m}_avg, stddev_samp({m}) over w as {m}_sd"
        for m in metrics
    )
    return f"""
quartiles as (select department, {quartiles} from dept group by department),
spreads as (select department, {spreads} from dept join quartiles using (department) group by department),
seasons as (select department, semana, {seasons} from dept group by department, semana),
season_spreads as (
  select department, semana, {season_spreads}
  from dept join seasons using (department, semana) group by department, semana),
rolling as (select department, week_start, {rolling} from dept window w as ({frame})),
stats as (
  select * from dept join quartiles using (department) join spreads using (department)
  join seasons using (department, semana) join season_spreads using (department, semana)
  join rolling using (department, week_start))"""


def _fence(m: str, low: bool) -> str:
    sign, quarter = ("-", "q1") if low else ("+", "q3")
    return f"({m}_{quarter} {sign} cast(1.5 as double) * ({m}_q3 - {m}_q1))"


def _scores(m: str) -> dict[str, str]:
    mad = f"0.6745 * ({m} - {m}_med) / nullif({m}_mad, 0)"
    seas = f"0.6745 * ({m} - {m}_smed) / nullif({m}_smad, 0)"
    roll = f"case when {m}_n >= 6 then ({m} - {m}_avg) / nullif({m}_sd, 0) end"
    return {
        f"{m}__iqr_low": _fence(m, True),
        f"{m}__iqr_high": _fence(m, False),
        f"{m}__is_iqr": f"({m} < {_fence(m, True)} or {m} > {_fence(m, False)})",
        f"{m}__mad_score": mad,
        f"{m}__is_mad": f"(abs({mad}) > 3.5)",
        f"{m}__roll_z": roll,
        f"{m}__is_roll": f"(abs({roll}) > 3.0)",
        f"{m}__seas_score": seas,
        f"{m}__is_seas": f"(abs({seas}) > 3.5)",
    }


_ALL_SCORES = {n: e for m in DETECT for n, e in _scores(m).items()}
DETECTED = f"""{DEPT},{_stats(DETECT)},
detected as (
  select department, week_start, ano, semana, {', '.join(DETECT)},
    {', '.join(f'{e} as {n}' for n, e in _ALL_SCORES.items())}
  from stats)"""
OUTLIER_FLAGS = [f"{m}__is_{k}" for m in DETECT for k in METHODS]
SUMMARY = f"""{DETECTED},
summary as (
  select department, {', '.join(f'count(*) filter (where {f}) as {f}' for f in OUTLIER_FLAGS)},
    count(*) as n_obs
  from detected group by department)"""
def _method(suffixes: list[str]) -> str:
    def portable(m: str, s: str) -> str:
        name = f"{m}__{s}"
        return f"{_positive_zero(f'round({name}, 6)')} as {name}" if s == "roll_z" else name

    columns = ", ".join(portable(m, s) for m in DETECT for s in suffixes)
    return f"with {DETECTED} select department, week_start, {', '.join(DETECT)}, {columns} from detected"


def _linear() -> str:
    quartiles = ", ".join(
        f"quantile_cont({m}, 0.25) as {m}_q1, quantile_cont({m}, 0.75) as {m}_q3" for m in DETECT
    )
    columns = ", ".join(
        f"{_fence(m, True)} as {m}__iqr_low, {_fence(m, False)} as {m}__iqr_high, "
        f"({m} < {_fence(m, True)} or {m} > {_fence(m, False)}) as {m}__is_iqr"
        for m in DETECT
    )
    return f"""with {DEPT},
quartiles as (select department, {quartiles} from dept group by department)
select department, week_start, {', '.join(DETECT)}, {columns}
from dept join quartiles using (department)"""


_LABELS = {"IQR": "iqr", "MAD": "mad", "Rolling": "roll", "Seasonal": "seas"}
_PEAK_METRIC = "cases_total"
_PEAKS = " union all ".join(
    f"select department, '{label}' as method, week_start, {_PEAK_METRIC} from detected "
    f"join leaders using (department) where {_PEAK_METRIC}__is_{k}"
    for label, k in _LABELS.items()
)
_PLANTED = (
    "case when department = 'NATION_0' or n < 30 then 0 else cast(floor(n * 0.01 - 0.01) as bigint) end"
)
_SHARE = "count * 100 / n_rows as pct"
_STREAMED_WEEK = "cast(date_trunc('week', ts) as date)"


def _raw(rows: str, keys: str, group: str, order: str, metrics: list[str], suffixes: list[str]) -> str:
    """The detectors on the rows of a group, whatever its length."""
    ranked = ", ".join(f"row_number() over (partition by {group} order by {m}) as {m}_rank" for m in metrics)
    places = ", ".join(
        f"max(case when {m}_rank = floor((n - 1) * {q} + 0.5) + 1 then {m} end) over g as {m}_{name}"
        for m in metrics for name, q in (("q1", 0.25), ("q3", 0.75))
    )
    medians = ", ".join(f"median({m}) over g as {m}_median" for m in metrics)
    rolled = ", ".join(f"avg({m}) over r as {m}_avg, stddev_samp({m}) over r as {m}_sd, count({m}) over r as {m}_n" for m in metrics)
    spreads = ", ".join(f"median(abs({m} - {m}_median)) over (partition by {group}) as {m}_mad" for m in metrics)
    columns = []
    for m in metrics:
        low, high = (f"({m}_q{i} {sign} cast(1.5 as double) * ({m}_q3 - {m}_q1))" for i, sign in ((1, "-"), (3, "+")))
        mad = f"(cast(0.6745 as double) * ({m} - {m}_median) / nullif({m}_mad, 0))"
        roll = f"(case when {m}_n >= 6 then ({m} - {m}_avg) / nullif({m}_sd, 0) end)"
        every = {
            "iqr_low": low, "iqr_high": high, "is_iqr": f"({m} < {low} or {m} > {high})",
            "mad_score": _positive_zero(f"round({mad}, 6)"), "is_mad": f"(abs({mad}) > 3.5)",
            "roll_z": _positive_zero(f"round({roll}, 6)"), "is_roll": f"(abs({roll}) > 3.0)",
        }
        columns += [f"{every[x]} as {m}__{x}" for x in suffixes]
    return f"""with ranked as (select *, count(*) over (partition by {group}) as n, {ranked} from ({rows}) as raw_rows),
measured as (select *, {places}, {medians}, {rolled} from ranked
  window g as (partition by {group}), r as (partition by {group} order by {order} rows between 6 preceding and 6 following)),
spread as (select *, {spreads} from measured)
select {keys}, {', '.join(columns)} from spread"""


_LINES = ("select * from lineitem", "l_orderkey, l_linenumber, l_returnflag", "l_returnflag", "l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice", ["l_quantity", "l_extendedprice"])
_EVENT_DAYS = "select event_type, cast(ts as date) as day, count(*) as n from events group by all"


# The dates in the results, which both sides give as text.
_SPAN = ("date_min", "date_max")
_DATES: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("coverage_department", "coverage_province", "coverage_low", "csv_roundtrip"), _SPAN),
    **dict.fromkeys(
        (
            "integrity_flags integrity_issues integrity_cells dedup_province dedup_department "
            "flag_deaths clamp_cases clean_province series_department outlier_iqr "
            "outlier_iqr_linear outlier_mad outlier_rolling outlier_seasonal outlier_detail "
            "outlier_series outlier_peaks parquet_roundtrip stream_row_checks stream_event_weeks "
            "outlier_detail_forest dedup_passthrough"
        ).split(),
        ("week_start",),
    ),
    "stream_dedup": ("week_start",),
    "stream_live_series": ("day",),
}


def oracle_sql() -> dict[str, str]:
    """SQL per registered query."""
    sqls = _sqls()
    for name, dates in _DATES.items():
        texts = ", ".join(f"cast({c} as varchar) as {c}" for c in dates)
        sqls[name] = f"select * replace ({texts}) from ({sqls[name]}) as result"
    return sqls


def _sqls() -> dict[str, str]:
    issue_columns = ", ".join(
        ["department", "ubigeo", "week_start", *HOSP, *DEATHS, "cases_total", *CHECKS]
    )
    overview = ", ".join(f"{n}, round_even({n} * 100 / n_rows, 3) as {n}_pct" for n in CHECKS)
    counts = _long(list(CHECKS), "totals", "check", "count")
    nulls = " union all ".join(
        f"select {i} as position, '{c}' as \"column\", count(*) filter (where {c} is null) as nulls, "
        f"round_even(count(*) filter (where {c} is null) / count(*) * 100, 3) as pct from prov"
        for i, c in enumerate(PROV_COLUMNS)
    )
    clean_columns = f"department, province, week_start, ubigeo, ano, semana, {', '.join(MEASURES + INCIDENCES)}"
    return {
        "integrity_flags": f"with {FLAGGED} select ubigeo, week_start, {', '.join(CHECKS)} from flagged",
        "integrity_totals": f"with {TOTALS} select * from totals",
        "integrity_issues": f"with {FLAGGED} select {issue_columns} from flagged "
        f"where {' or '.join(CHECKS)}",
        "duplicate_count": f"with {PROV} select {_DUPLICATES} as duplicados",
        "coverage_department": _coverage("department"),
        "coverage_province": _coverage(_REGION),
        "coverage_low": f"select * from ({_coverage(_REGION)}) where pct_cobertura < 95",
        "integrity_cells": f"with {FLAGGED} select department, ano, week_start, count(*) as n_rows, "
        + ", ".join(f"count(*) filter (where {c} is null) as nulls__{c}" for c in PROV_COLUMNS)
        + f", {_SUMS} from flagged group by department, ano, week_start",
        "null_profile": f"with {PROV} select \"column\", nulls, pct from ({nulls})",
        "null_top": f"with {PROV} select \"column\", nulls, pct from ({nulls}) where nulls > 0 "
        "order by nulls desc, position limit 5",
        "null_pct_department": _null_shares("department"),
        "null_pct_year": _null_shares("ano"),
        "overview": f"with {TOTALS} select 'weekly_prov' as tabla, n_rows as filas, "
        f"{_DUPLICATES} as duplicados, {overview} from totals",
        "issue_ranking": f"with {TOTALS} select substr(\"check\", 6) as \"check\", count, {_SHARE} "
        f"from ({counts} union all select 20, '_chk_duplicates', {_DUPLICATES}, n_rows from totals) "
        "where count > 0",
        "check_ranking": f"with {TOTALS} select \"check\", count, {_SHARE}, "
        f"count * 100 / n_rows >= 1.0 as severe from {counts}",
        "dedup_province": f"with {DEDUP_PROV} select {clean_columns} from dedup",
        "dedup_department": f"with {_dedup('department, week_start')} select department, week_start, "
        f"ubigeo, ano, semana, {', '.join(MEASURES + INCIDENCES)} from dedup",
        "flag_deaths": f"with {DEDUP_PROV} select {clean_columns}, {_DEATH_FLAG} from dedup",
        "clamp_cases": f"with {DEDUP_PROV}, clamped as (select {_CLAMPED} from dedup) "
        f"select {clean_columns}, flag_hosp_corrected from clamped",
        "clean_province": f"with {CLEAN} select {clean_columns}, flag_death_no_hosp, "
        "flag_hosp_corrected from clean",
        "cleaning_audit": f"with {CLEAN}, sizes as (select (select count(*) from prov) as n_in, "
        "(select count(*) from clean) as n_out) select 'weekly_prov' as name, n_in as \"in\", "
        "n_out as \"out\", n_in - n_out as dups_removed, "
        "(select count(*) filter (where flag_death_no_hosp) from clean) as flag_death_no_hosp, "
        "(select count(*) filter (where flag_hosp_corrected) from clean) as flag_hosp_corrected "
        "from sizes",
        "silence_rate": f"with {SILENCE} select * from rate",
        "silence_yearly": f"with {SILENCE} select department, province, ano, pct from yearly",
        "silence_slope": f"with {SILENCE} select * from slope",
        "silence_report": f"with {SILENCE} select *, case when slope_pct_per_year > 0 then 'worsens' "
        "when slope_pct_per_year < 0 then 'improves' else 'steady' end as trend from report",
        "silence_top15": f"with {SILENCE} select * from report "
        "order by pct_silence desc, department, province limit 15",
        "series_department": f"with {DEPT} select department, week_start, {', '.join(DETECT)}, ano, semana from dept",
        "outlier_iqr": _method(["iqr_low", "iqr_high", "is_iqr"]),
        "outlier_iqr_linear": _linear(),
        "outlier_mad": _method(["mad_score", "is_mad"]),
        "outlier_rolling": _method(["roll_z", "is_roll"]),
        "outlier_seasonal": _method(["seas_score", "is_seas"]),
        "outlier_summary": f"with {SUMMARY} select * from summary",
        "outlier_detail": f"with {DETECTED} select department, ano, semana, week_start, {', '.join(DETECT)}, "
        f"{', '.join(OUTLIER_FLAGS)} from detected where {' or '.join(OUTLIER_FLAGS)}",
        "outlier_totals": f"with {SUMMARY}, totals as (select cast(sum(n_obs) as bigint) as n_rows, "
        f"{', '.join(f'cast(sum({f}) as bigint) as {f}' for f in OUTLIER_FLAGS)} from summary) "
        "select method, flagged, round_even(flagged * 100 / n_rows, 2) as pct "
        f"from {_long(OUTLIER_FLAGS, 'totals', 'method', 'flagged')}",
        "outlier_top_groups": f"with {SUMMARY} select department, cases_total__is_iqr, n_obs from summary "
        "order by cases_total__is_iqr desc, department limit 5",
        "outlier_series": f"with {DETECTED} select week_start, cases_total, "
        f"{', '.join(f'cases_total__is_{k} as {label}' for label, k in _LABELS.items())} "
        "from detected where department = 'NATION_0'",
        # The forest's random numbers cannot be drawn here; what must hold for any of them can be said.
        "iforest_summary": f"with {SUMMARY} select department, n_obs, true as within_quota from summary",
        "iforest_top_groups": f"with {SUMMARY} select cast(place as int) as place, true as is_top "
        "from range(1, 6) as places(place) where place <= (select count(*) from summary)",
        "iforest_planted": f"with {DEPT}, sized as (select department, count(*) as n from dept group by all) "
        "select department, case when department = 'NATION_0' then least(n, 29) else n end as n_obs, "
        f"{_PLANTED} as planted, {_PLANTED} as planted_flagged, "
        "department <> 'NATION_0' and n >= 30 as is_scored from sized",
        "outlier_all_methods": f"with {SUMMARY} select *, true as within_quota from summary",
        "outlier_detail_forest": f"with {DETECTED} select department, week_start, {', '.join(DETECT)}, "
        f"{', '.join(OUTLIER_FLAGS)}, true as is_scored from detected where {' or '.join(OUTLIER_FLAGS)}",
        "outlier_totals_forest": f"with {SUMMARY}, totals as (select cast(sum(n_obs) as bigint) as n_rows, "
        f"{', '.join(f'cast(sum({f}) as bigint) as {f}' for f in OUTLIER_FLAGS)} from summary) "
        "select method, flagged, round_even(flagged * 100 / n_rows, 2) as pct, "
        f"cast(null as boolean) as within_quota from {_long(OUTLIER_FLAGS, 'totals', 'method', 'flagged')} "
        "union all select 'is_iforest', null, null, true",
        "outlier_top_mad": f"with {SUMMARY} select department, cases_total__is_mad, n_obs from summary "
        "order by cases_total__is_mad desc, department limit 4",
        "dedup_passthrough": f"with {PROV}, copied as (select department, province, week_start, "
        "case when (semana + copy) % 4 > 0 then ubigeo - semana % 2 end as ubigeo, "
        "case when (semana + copy) % 5 > 0 then ano - copy end as ano, semana, "
        "cases_total + copy % 2 as cases_total, hosp_total from prov cross join range(1, 4) as copies(copy)), "
        "placed as (select *, row_number() over (partition by department, province, week_start "
        "order by ubigeo nulls last, ano nulls last, semana nulls last) as place, "
        "max(cases_total) over k as most_cases, max(hosp_total) over k as most_hosp from copied "
        "window k as (partition by department, province, week_start)) "
        "select department, province, week_start, most_cases as cases_total, most_hosp as hosp_total, "
        "ubigeo, ano, semana from placed where place = 1",
        "overview_tables": f"with {TOTALS}, dept as (select department, week_start, "
        "cast(extract(year from week_start) as int) as ano, cast(weekofyear(week_start) as int) as semana, "
        f"{', '.join(f'cast(sum({m}) as bigint) as {m}' for m in MEASURES)} from cells group by department, week_start), "
        f"dept_flagged as (select *, {_FLAGS} from dept), "
        f"dept_totals as (select count(*) as n_rows, {_SUMS} from dept_flagged) "
        f"select 'weekly_prov' as tabla, n_rows as filas, {_DUPLICATES} as duplicados, {overview} from totals "
        f"union all select 'weekly_dept', n_rows, 0, {overview} from dept_totals",
        "missing_inputs": f"with {PROV} select 'weekly_prov' as \"table\", true as present, count(*) as rows "
        "from prov union all select 'not_there', false, null",
        "validation_overview": f"with {TOTALS} select 'weekly_prov' as tabla, n_rows as filas, "
        f"{_DUPLICATES} as duplicados, {overview} from totals",
        "validation_increment": f"with {TOTALS} select 'weekly_prov' as tabla, n_rows as filas, "
        f"{_DUPLICATES} as duplicados, {overview}, n_rows as filas_leidas from totals",
        "stream_row_checks": f"with {FLAGGED} select ubigeo, week_start, "
        "greatest(cases_total, coalesce(hosp_total, 0)) as cases_total, "
        f"{', '.join(CHECKS)}, _chk_logic__deaths_gt_hosp as flag_death_no_hosp, "
        "_chk_logic__hosp_gt_cases as flag_hosp_corrected from flagged",
        "outlier_iqr_raw": _raw(*_LINES, ["iqr_low", "iqr_high", "is_iqr"]),
        "outlier_mad_raw": _raw(*_LINES, ["mad_score", "is_mad"]),
        "outlier_rolling_raw": _raw(*_LINES, ["roll_z", "is_roll"]),
        "top_share_raw": "with cuts as (select l_returnflag, quantile_cont(l_extendedprice, 0.99) as cut, count(*) as n "
        "from lineitem group by all) select l_orderkey, l_linenumber, l_returnflag, n >= 30 and l_extendedprice > cut as is_top "
        "from lineitem join cuts using (l_returnflag)",
        "iforest_raw": "select l_returnflag, count(*) as n_obs, count(*) filter (where l_orderkey % 997 = 0) as planted, "
        "count(*) filter (where l_orderkey % 997 = 0) as planted_flagged, true as within_quota, true as is_scored "
        "from lineitem group by all",
        "stream_live_series": _raw(
            _EVENT_DAYS.replace("as n ", "as m "), "event_type, day, m as n", "event_type", "day", ["m"],
            ["iqr_low", "iqr_high", "is_iqr", "mad_score", "is_mad", "roll_z", "is_roll"],
        ).replace("as m__", "as n__"),
        "stream_dedup": f"with {DEDUP_PROV} select {clean_columns} from dedup",
        "snapshot_rerun": "with sizes as (select (select count(*) from customer) as c, (select count(*) from orders) as o, "
        "(select count(*) from customer where c_custkey % 10 <> 3) as cs, (select count(*) from orders where o_orderkey % 10 <> 3) as os) "
        "select 'first' as step, 'customer' as \"table\", 'written' as status, c as rows, c as source_rows, c as rows_there from sizes "
        "union all select 'short', 'customer', 'error', cs, c, c from sizes "
        "union all select 'short', 'orders', 'error', os, o, null from sizes "
        "union all select 'again', 'customer', 'skipped', null, null, c from sizes "
        "union all select 'again', 'orders', 'written', o, o, o from sizes",
        "stream_event_repeats": "select event_id, user_id, event_type from events",
        "stream_event_weeks": f"select event_type, {_STREAMED_WEEK} as week_start, count(*) as n "
        f"from events where {_STREAMED_WEEK} + interval 8 day <= (select max(ts) from events) "
        "group by all",
        "snapshot_status": " union all ".join(
            f"select '{t}' as \"table\", 'written' as status, count(*) as rows, count(*) as source_rows, "
            f"true as is_timed, cast(null as varchar) as error from {t}"
            for t in TABLES
        )
        + " union all select 'region', 'skipped', null, null, null, null"
        + " union all select 'unreadable', 'error', null, null, true, 'ConnectionError: '",
        "csv_roundtrip": _coverage(_REGION),
        "parquet_roundtrip": f"with {CLEAN} select {clean_columns}, flag_death_no_hosp, "
        "flag_hosp_corrected from clean",
        "outlier_peaks": f"with {SUMMARY}, leaders as (select department from summary "
        f"order by {_PEAK_METRIC}__is_mad desc, department limit 4), "
        f"hits as ({_PEAKS}), placed as (select *, row_number() over (partition by department, method "
        f"order by {_PEAK_METRIC} desc, week_start) as place from hits) "
        f"select department, method, place, week_start, {_PEAK_METRIC} from placed where place <= 8",
    }
