"""The registered queries: every operator on the weekly tables of one scale factor."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fixtures.weekly import (
    WEEKLY_DEPT,
    WEEKLY_PROV,
    WEEKLY_PROV_BY_DEPARTMENT,
    replicated,
    weekly_dept,
    weekly_prov,
)
from weekwatch.functions import any_true
from weekwatch.functions.cutoffs import flag_top_share
from weekwatch.operators import checks, cleaning, iforest, outlier_reports, profile, raw_forest, raw_outliers, silence
from weekwatch.operators import outliers as detectors
from weekwatch.plans.common import each_table
from weekwatch.plans.detection import flag_all, series_of
from weekwatch.plans.increment import validate_increment
from weekwatch.plans.validation import validate
from weekwatch.sources.parquet_source import ParquetSource
from weekwatch.sources.scratch import scratch_dir, store
from weekwatch.sources.snapshot import snapshot_tables
from weekwatch.sources.tables import conform, path_exists, read_csv, write_csv
from weekwatch.sources.upsert import UpsertTable
from weekwatch.streaming import stored
from weekwatch.streaming import weekly as streaming

Query = Callable[[SparkSession, str], DataFrame]
REGION = WEEKLY_PROV.silence_keys
MEASURES = WEEKLY_PROV.measure_cols
DEPARTMENT = WEEKLY_DEPT.group_keys
METRICS = WEEKLY_DEPT.detect_metrics
SERIES_KEYS = ["department", "week_start"]
PEAK_METRIC = "cases_total"
# Fixed value: the columns of the given event table that are read.
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Scores that depend on the order of a sum, to six digits."""
    return df.withColumns({c: F.round(c, 6) for c in names})


def _as_text(query: Query) -> Query:
    """Dates as text: engines hand them over as different objects."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})

    return run


def _prov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(weekly_prov(spark, sf_dir), WEEKLY_PROV)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_of(conform(weekly_dept(spark, sf_dir), WEEKLY_DEPT), WEEKLY_DEPT)


def _on_prov(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(_prov(spark, sf_dir))


def _on_series(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(_series(spark, sf_dir))


def _totals(df: DataFrame) -> DataFrame:
    return checks.flag_totals(df, WEEKLY_PROV)


def _duplicates(df: DataFrame) -> DataFrame:
    return profile.duplicate_count(df, WEEKLY_PROV.key_cols)


def _dedup(df: DataFrame) -> DataFrame:
    spec = WEEKLY_PROV
    return cleaning.deduplicate(
        df, spec.natural_key, spec.metrics, spec.passthrough, spec.tie_break
    )


def _dedup_department(df: DataFrame) -> DataFrame:
    spec = WEEKLY_PROV_BY_DEPARTMENT
    return cleaning.deduplicate(
        df, spec.natural_key, spec.metrics, spec.passthrough, spec.tie_break
    )


def _dedup_passthrough(df: DataFrame) -> DataFrame:
    """Copies of a cell that differ in what is passed through, with missing and equal tie-breaks."""
    copy = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy")
    shifted = df.select("*", copy).withColumns(
        {
            "ubigeo": F.when((F.col("semana") + F.col("copy")) % 4 > 0, F.col("ubigeo") - F.col("semana") % 2),
            "ano": F.when((F.col("semana") + F.col("copy")) % 5 > 0, F.col("ano") - F.col("copy")),
            "cases_total": F.col("cases_total") + F.col("copy") % 2,
        }
    )
    spec = WEEKLY_PROV
    return cleaning.deduplicate(
        shifted, spec.natural_key, ["cases_total", "hosp_total"], spec.passthrough, spec.tie_break
    )


def _audit(df: DataFrame) -> DataFrame:
    return cleaning.cleaning_audit(df, cleaning.clean_table(df, WEEKLY_PROV), "weekly_prov")


def _yearly(df: DataFrame) -> DataFrame:
    return silence.silence_rate_yearly(df, REGION, WEEKLY_PROV)


def _silence(df: DataFrame) -> DataFrame:
    return silence.silence_report(df, REGION, WEEKLY_PROV)


def _per_metric(flag: Callable[..., DataFrame], *suffixes: str, **settings) -> Query:
    """One detector on all metrics, with the columns it adds."""

    def run(series: DataFrame) -> DataFrame:
        flagged = flag(series, DEPARTMENT, METRICS, **settings)
        added = [f"{m}__{s}" for m in METRICS for s in suffixes]
        sums = [c for c in added if c.endswith("__roll_z")]
        return _rounded(flagged.select(*SERIES_KEYS, *METRICS, *added), *sums)

    return _on_series(run)


UNIVARIATE = detectors.flag_columns(METRICS)


def _flagged(series: DataFrame) -> DataFrame:
    return detectors.flag_univariate(series, DEPARTMENT, METRICS)


def _summary(series: DataFrame) -> DataFrame:
    return outlier_reports.outlier_summary(_flagged(series), DEPARTMENT, UNIVARIATE)


def _detail(series: DataFrame) -> DataFrame:
    keys = ["department", "ano", "semana", "week_start"]
    return outlier_reports.outlier_detail(_flagged(series), keys, METRICS, UNIVARIATE)


def _forest(series: DataFrame) -> DataFrame:
    return iforest.flag_isolation_forest(store(series, "series"), DEPARTMENT, METRICS)


def _quota() -> Column:
    """At most so many of ``n_obs`` rows lie beyond the threshold; equal scores make it fewer."""
    most = F.floor(F.col("n_obs") * F.lit(0.01) - F.lit(0.01)).cast("bigint") + 1
    return F.when(F.col("n_obs") < iforest.MIN_ROWS, 0).otherwise(most)


def _within_quota(summary: DataFrame) -> DataFrame:
    kept = [c for c in summary.columns if c != "is_iforest"]
    return summary.select(*kept, (F.col("is_iforest") <= _quota()).alias("within_quota"))


def _forest_counts(series: DataFrame) -> DataFrame:
    return outlier_reports.outlier_summary(_forest(series), DEPARTMENT, ["is_iforest"])


def _forest_summary(series: DataFrame) -> DataFrame:
    return _within_quota(_forest_counts(series))


def _forest_top(series: DataFrame) -> DataFrame:
    """The places of the ranking, and whether a department outside of it has more flags."""
    summary = store(_forest_counts(series), "summary")
    top = outlier_reports.top_groups(summary, DEPARTMENT).select("department", F.lit(True).alias("in_top"))
    everyone, best = Window.partitionBy(), Window.orderBy(F.desc("is_iforest"), "department")
    outside = F.max(F.when(F.col("in_top").isNull(), F.col("is_iforest"))).over(everyone)
    held = F.coalesce(F.col("is_iforest") >= outside, F.lit(True)).alias("is_top")
    placed = summary.join(top, "department", "left").select("in_top", F.row_number().over(best).alias("place"), held)
    return placed.where("in_top").select("place", "is_top")


def _with_forest(series: DataFrame) -> DataFrame:
    return store(flag_all(store(series, "series"), WEEKLY_DEPT), "flagged")


ALL_FLAGS = detectors.flag_columns(METRICS, forest=True)


def _all_methods(series: DataFrame) -> DataFrame:
    return _within_quota(outlier_reports.outlier_summary(_with_forest(series), DEPARTMENT, ALL_FLAGS))


def _detail_with_forest(series: DataFrame) -> DataFrame:
    """The weeks that a univariate method flags, out of those that any method flags."""
    keys = ["department", "week_start"]
    detail = outlier_reports.outlier_detail(_with_forest(series), keys, METRICS, ALL_FLAGS)
    scored = F.col("iforest_score").between(0.0, 1.0) & F.col("is_iforest").isNotNull()
    return detail.where(any_true(UNIVARIATE)).select(*keys, *METRICS, *UNIVARIATE, scored.alias("is_scored"))


def _totals_with_forest(series: DataFrame) -> DataFrame:
    """Totals per method; of the forest only that it flags at most one percent and one row a department."""
    flagged = _with_forest(series)
    totals = outlier_reports.method_totals(
        outlier_reports.outlier_summary(flagged, DEPARTMENT, ALL_FLAGS), ALL_FLAGS
    )
    forest = F.col("method") == "is_iforest"
    return totals.select(
        "method",
        F.when(~forest, F.col("flagged")).alias("flagged"),
        F.when(~forest, F.col("pct")).alias("pct"),
        F.when(forest, F.col("pct") <= 1.0 + 100.0 / iforest.MIN_ROWS).alias("within_quota"),
    )


def _forest_planted(series: DataFrame) -> DataFrame:
    """The earliest weeks of each department are made extreme, as many as the forest may flag.

    One department is cut to fewer rows than a forest needs; its scores are zero.
    """
    early = Window.partitionBy("department").orderBy("week_start")
    rows = series.withColumns(
        {
            "place": F.row_number().over(early),
            "n_obs": F.count(F.lit(1)).over(Window.partitionBy("department")),
        }
    )
    short = (F.col("department") == "NATION_0") & (F.col("place") >= iforest.MIN_ROWS)
    planted = (F.col("place") < _quota()) & (F.col("department") != "NATION_0")
    extreme = {m: F.when(planted, 1_000_000 + F.col("place") * 1000).otherwise(F.col(m)) for m in METRICS}
    rows = rows.where(~short).withColumns({"planted": planted, **extreme})
    found = iforest.flag_isolation_forest(store(rows.drop("n_obs"), "planted"), DEPARTMENT, METRICS)
    return found.groupBy("department").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count_if("planted").alias("planted"),
        F.count_if(F.col("planted") & F.col("is_iforest")).alias("planted_flagged"),
        (F.max("iforest_score") > 0).alias("is_scored"),
    )


def _peaks(series: DataFrame) -> DataFrame:
    return outlier_reports.peak_labels(store(_flagged(series), "flagged"), DEPARTMENT, PEAK_METRIC)


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out = _new_path(spark, "streamed")
    streaming.run_available(stream, out, _new_path(spark, "stream-state"), fail_on_late=True)
    return spark.read.parquet(out)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streaming.read_table(spark, f"{sf_dir}/events.parquet", EVENT_SCHEMA)
    return events.withColumn("ts", streaming.utc_instant("ts"))


def stream_row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row checks on the weekly table, arriving as files."""
    path = _new_path(spark, "arriving")
    _prov(spark, sf_dir).write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = streaming.check_rows(streaming.read_files(spark, path, schema), WEEKLY_PROV)
    kept = ["ubigeo", "week_start", "cases_total", *checks.flag_names(WEEKLY_PROV)]
    return _streamed(spark, stream).select(*kept, cleaning.DEATH_FLAG, cleaning.CLAMP_FLAG)


def stream_event_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives three times and is let through once."""
    stream = replicated(_events(spark, sf_dir), 3)
    once = streaming.drop_repeats(stream, ["event_id"], "ts", "1 day")
    return _streamed(spark, once.select("event_id", "user_id", "event_type"))


def stream_event_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and week, for the weeks that are closed."""
    stream = _events(spark, sf_dir)
    return _streamed(spark, streaming.weekly_counts(stream, ["event_type"], "ts", "1 day"))


def snapshot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy every given table, one of them again, and one that cannot be read."""
    out, source = _new_path(spark, "snapshot"), _Unreadable(spark, sf_dir)
    done = snapshot_tables(spark, source, out)
    again = snapshot_tables(spark, source, out, ["region"])
    broken = snapshot_tables(spark, source, out, ["unreadable"])
    timed = (F.col("seconds") > 0).alias("is_timed")
    return done.union(again).union(broken).select("table", "status", "rows", "source_rows", timed, "error")


class _Unreadable(ParquetSource):
    """The given tables, and one that fails without a text."""

    def count(self, table: str) -> int:
        if table == "unreadable":
            raise ConnectionError
        return super().count(table)


class _Short(ParquetSource):
    """The given tables, with rows lost on the way while ``short``."""

    short = True

    def read(self, table: str) -> DataFrame:
        rows = super().read(table)
        return rows.where(F.col(rows.columns[0]) % 10 != 3) if self.short else rows


def snapshot_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that come short, of a table that is there and of one that is not, and what a rerun makes of them."""
    out, source = _new_path(spark, "snapshot"), _Short(spark, sf_dir)
    steps = []

    def step(name: str, tables: list[str], short: bool, force: bool = False) -> None:
        source.short = short
        done = {r["table"]: r for r in snapshot_tables(spark, source, out, tables, force).collect()}
        for table in tables:
            path, r = f"{out}/{table}.parquet", done[table]
            there = spark.read.parquet(path).count() if path_exists(spark, path) else None
            steps.append((name, table, r["status"], r["rows"], r["source_rows"], there))

    step("first", ["customer"], short=False)
    step("short", ["customer", "orders"], short=True, force=True)
    step("again", ["customer", "orders"], short=False)
    return spark.createDataFrame(steps, "step string, table string, status string, rows bigint, source_rows bigint, rows_there bigint")


def validation_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that comes in two halves, validated after each; ``filas_leidas`` are the rows that both runs read."""
    path, kept = _new_path(spark, "growing"), _new_path(spark, "kept")
    rows = store(_prov(spark, sf_dir), "growing-rows")
    early = F.coalesce(F.pmod(F.xxhash64("ubigeo", "semana"), F.lit(2)) == 0, F.lit(False))
    for half in (rows.where(early), rows.where(~early)):
        half.write.mode("append").parquet(path)
        found = validate_increment(spark, path, WEEKLY_PROV, kept)
    read = spark.read.parquet(f"{kept}/cells").agg(F.sum("n_rows")).first()[0]
    return found.overview.withColumn("filas_leidas", F.lit(read).cast("bigint"))


def _arriving(spark: SparkSession, rows: DataFrame, files: int) -> DataFrame:
    """The rows as a stream of several batches, in any order."""
    path = _new_path(spark, "arriving")
    rows.repartition(files).write.parquet(path)
    return streaming.read_files(spark, path, spark.read.parquet(path).schema, maxFilesPerTrigger=1)


EVENT_METRICS = ["n"]
EVENT_FLAGS = ["iqr_low", "iqr_high", "is_iqr", "mad_score", "is_mad", "roll_z", "is_roll"]
EVENT_FLAG_SCHEMA = (
    "event_type string, day date, n bigint, n__iqr_low double, n__iqr_high double, n__is_iqr boolean, "
    "n__mad_score double, n__is_mad boolean, n__roll_z double, n__is_roll boolean"
)


def _flag_events(series: DataFrame) -> DataFrame:
    flagged = detectors.flag_iqr(series, ["event_type"], EVENT_METRICS)
    flagged = detectors.flag_mad(flagged, ["event_type"], EVENT_METRICS)
    return detectors.flag_rolling_z(flagged, ["event_type"], EVENT_METRICS, "day")


def stream_live_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts per event type kept up by a stream, and the flags that follow them; compacted on the way."""
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    stream = _arriving(spark, events.select("event_type", F.to_date("ts").alias("day"), F.lit(1).alias("n")), 4)
    live = stored.LiveSeries(spark, _new_path(spark, "live"), "event_type string", "day", EVENT_METRICS, _flag_events, EVENT_FLAG_SCHEMA)
    stored.keep_up(stream, live.add, _new_path(spark, "live-state"))
    live.compact()
    return _rounded(live.flags(), "n__mad_score", "n__roll_z")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly table, each row of it repeated, arriving in several batches in any order."""
    spec, rows = WEEKLY_PROV, _prov(spark, sf_dir)
    stream = stored.deduplicate_stream(
        _arriving(spark, rows, 3), spec.natural_key, spec.metrics, spec.passthrough, spec.tie_break, "week_start", "36500 days"
    )
    table = UpsertTable(spark, _new_path(spark, "kept"), stream.schema, spec.natural_key)
    stored.keep_up(stream, table.put, _new_path(spark, "kept-state"), "update", fail_on_late=True)
    table.compact()
    return table.latest()


LINE_GROUP, LINE_KEY = ["l_returnflag"], ["l_orderkey", "l_linenumber"]
LINE_METRICS = ["l_quantity", "l_extendedprice"]


def _on_lines(flag: Callable[[DataFrame], DataFrame], *suffixes: str) -> Query:
    """A detector on all lines of all orders, in groups that each hold a third of them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        added = [f"{m}__{s}" for m in LINE_METRICS for s in suffixes]
        flagged = flag(lines.select(*LINE_KEY, *LINE_GROUP, "l_shipdate", *LINE_METRICS))
        scores = [c for c in added if c.endswith(("_score", "_z"))]
        return _rounded(flagged.select(*LINE_KEY, *LINE_GROUP, *added), *scores)

    return run


def top_share_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest hundredth of all lines in groups that each hold a third of them."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINE_KEY, *LINE_GROUP, "l_extendedprice")
    return flag_top_share(lines, LINE_GROUP, "l_extendedprice", iforest.CONTAMINATION, "is_top", iforest.MIN_ROWS).drop("l_extendedprice")


def iforest_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest on all lines, of which one in a thousand orders is made extreme."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    planted = F.col("l_orderkey") % 997 == 0
    extreme = {m: F.when(planted, F.col(m) * 1000).otherwise(F.col(m)) for m in LINE_METRICS}
    line = F.xxhash64(*lines.columns).alias("line")
    rows = store(lines.select("*", line, planted.alias("planted")).withColumns(extreme).select(*LINE_GROUP, "line", "planted", *LINE_METRICS), "lines")
    found = raw_forest.flag_isolation_forest(rows, LINE_GROUP, LINE_METRICS, "line")
    return found.groupBy(*LINE_GROUP).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count_if("planted").alias("planted"),
        F.count_if(F.col("planted") & F.col("is_iforest")).alias("planted_flagged"),
        (F.count_if("is_iforest") <= F.count(F.lit(1)) * 0.01 + 1).alias("within_quota"),
        ((F.min("iforest_score") > 0) & (F.max("iforest_score") <= 1)).alias("is_scored"),
    )


def missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job over two tables of which one is not there."""
    folder = _new_path(spark, "raw")
    _prov(spark, sf_dir).write.parquet(f"{folder}/{WEEKLY_PROV.file_name}")
    specs = [WEEKLY_PROV, WEEKLY_PROV.with_(name="not_there")]
    done, missing = each_table(spark, folder, specs, lambda df, spec: df.count())
    rows = [(name, True, n) for name, n in done.items()] + [(name, False, None) for name in missing]
    return spark.createDataFrame(rows, "table string, present boolean, rows bigint")


def overview_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview of two tables."""
    both = ((_prov(spark, sf_dir), WEEKLY_PROV), (conform(weekly_dept(spark, sf_dir), WEEKLY_DEPT), WEEKLY_DEPT))
    return profile.integrity_overview(
        [
            profile.table_overview(
                checks.flag_totals(df, spec), profile.duplicate_count(df, spec.key_cols), spec
            )
            for df, spec in both
        ]
    )


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coverage = profile.temporal_coverage(_prov(spark, sf_dir), REGION, "week_start")
    path = _new_path(spark, "csv")
    write_csv(coverage, path)
    return read_csv(spark, path, coverage.schema)


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = cleaning.clean_table(_prov(spark, sf_dir), WEEKLY_PROV)
    return store(cleaned, "cleaned")


def queries() -> dict[str, Query]:
    return {name: _as_text(query) for name, query in _queries().items()}


def _queries() -> dict[str, Query]:
    spec = WEEKLY_PROV
    return {
        "integrity_flags": _on_prov(
            lambda df: checks.add_flags(df, spec).select(
                "ubigeo", "week_start", *checks.flag_names(spec)
            )
        ),
        "integrity_totals": _on_prov(_totals),
        "integrity_issues": _on_prov(lambda df: checks.issue_rows(df, spec)),
        "duplicate_count": _on_prov(_duplicates),
        "coverage_department": _on_prov(
            lambda df: profile.temporal_coverage(df, ["department"], "week_start")
        ),
        "coverage_province": _on_prov(
            lambda df: profile.temporal_coverage(df, REGION, "week_start")
        ),
        "coverage_low": _on_prov(
            lambda df: profile.low_coverage(profile.temporal_coverage(df, REGION, "week_start"))
        ),
        "integrity_cells": _on_prov(lambda df: profile.integrity_cells(df, spec)),
        "null_profile": _on_prov(profile.null_profile),
        "null_top": _on_prov(
            lambda df: profile.top_null_columns(profile.null_profile(df), df.columns)
        ),
        "null_pct_department": _on_prov(
            lambda df: profile.null_pct_by(df, MEASURES, ["department"])
        ),
        "null_pct_year": _on_prov(lambda df: profile.null_pct_by(df, MEASURES, ["ano"])),
        "overview": _on_prov(
            lambda df: profile.integrity_overview(
                [profile.table_overview(_totals(df), _duplicates(df), spec)]
            )
        ),
        "issue_ranking": _on_prov(
            lambda df: profile.issue_ranking(_totals(df), _duplicates(df), spec)
        ),
        "check_ranking": _on_prov(lambda df: profile.check_ranking(_totals(df), spec)),
        "dedup_province": _on_prov(_dedup),
        "dedup_department": _on_prov(_dedup_department),
        "flag_deaths": _on_prov(lambda df: cleaning.flag_deaths_gt_hosp(_dedup(df))),
        "clamp_cases": _on_prov(lambda df: cleaning.clamp_hosp_gt_cases(_dedup(df))),
        "clean_province": _on_prov(lambda df: cleaning.clean_table(df, spec)),
        "cleaning_audit": _on_prov(_audit),
        "silence_rate": _on_prov(lambda df: silence.silence_rate(df, REGION, spec)),
        "silence_yearly": _on_prov(_yearly),
        "silence_slope": _on_prov(
            lambda df: silence.trend_slope(_yearly(df), REGION, spec.year_col)
        ),
        "silence_report": _on_prov(lambda df: silence.trend_reading(_silence(df))),
        "silence_top15": _on_prov(lambda df: silence.top_silent(_silence(df), REGION)),
        "series_department": lambda spark, sf_dir: series_of(
            conform(replicated(weekly_dept(spark, sf_dir), 3), WEEKLY_DEPT), WEEKLY_DEPT
        ),
        "outlier_iqr": _per_metric(detectors.flag_iqr, "iqr_low", "iqr_high", "is_iqr"),
        "outlier_iqr_linear": _per_metric(
            detectors.flag_iqr, "iqr_low", "iqr_high", "is_iqr", interpolation="linear"
        ),
        "outlier_mad": _per_metric(detectors.flag_mad, "mad_score", "is_mad"),
        "outlier_rolling": _per_metric(detectors.flag_rolling_z, "roll_z", "is_roll"),
        "outlier_seasonal": _per_metric(detectors.flag_seasonal, "seas_score", "is_seas"),
        "outlier_summary": _on_series(_summary),
        "outlier_detail": _on_series(_detail),
        "outlier_totals": _on_series(
            lambda s: outlier_reports.method_totals(_summary(s), UNIVARIATE)
        ),
        "outlier_top_groups": _on_series(
            lambda s: outlier_reports.top_groups(_summary(s), DEPARTMENT, "cases_total__is_iqr")
        ),
        "outlier_series": _on_series(
            lambda s: outlier_reports.method_series(
                _flagged(s), F.col("department") == "NATION_0", PEAK_METRIC
            )
        ),
        "outlier_peaks": _on_series(_peaks),
        "iforest_scores": _on_series(lambda s: _rounded(_forest(s), "iforest_score")),
        "iforest_summary": _on_series(_forest_summary),
        "iforest_top_groups": _on_series(_forest_top),
        "iforest_planted": _on_series(_forest_planted),
        "outlier_all_methods": _on_series(_all_methods),
        "outlier_detail_forest": _on_series(_detail_with_forest),
        "outlier_totals_forest": _on_series(_totals_with_forest),
        "outlier_top_mad": _on_series(
            lambda s: outlier_reports.top_groups(_summary(s), DEPARTMENT, "cases_total__is_mad", 4)
        ),
        "dedup_passthrough": _on_prov(_dedup_passthrough),
        "overview_tables": overview_tables,
        "missing_inputs": missing_inputs,
        "snapshot_status": snapshot_status,
        "csv_roundtrip": csv_roundtrip,
        "parquet_roundtrip": parquet_roundtrip,
        "validation_overview": _on_prov(lambda df: validate(df, spec).overview),
        "validation_increment": validation_increment,
        "snapshot_rerun": snapshot_rerun,
        "outlier_iqr_raw": _on_lines(
            lambda df: raw_outliers.flag_iqr(df, LINE_GROUP, LINE_METRICS), "iqr_low", "iqr_high", "is_iqr"
        ),
        "outlier_mad_raw": _on_lines(
            lambda df: raw_outliers.flag_mad(df, LINE_GROUP, LINE_METRICS), "mad_score", "is_mad"
        ),
        "outlier_rolling_raw": _on_lines(
            lambda df: raw_outliers.flag_rolling_z(df, LINE_GROUP, LINE_METRICS, ["l_shipdate", *LINE_KEY, *LINE_METRICS], bucket_rows=5_000),
            "roll_z",
            "is_roll",
        ),
        "top_share_raw": top_share_raw,
        "iforest_raw": iforest_raw,
        "stream_live_series": stream_live_series,
        "stream_dedup": stream_dedup,
        "stream_row_checks": stream_row_checks,
        "stream_event_repeats": stream_event_repeats,
        "stream_event_weeks": stream_event_weeks,
    }
