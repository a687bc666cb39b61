import datetime

import pytest

from compare import spark_rows
from fixtures import queries
from fixtures.weekly import WEEKLY_PROV
from weekwatch.operators.checks import add_flags
from weekwatch.operators.cleaning import clamp_hosp_gt_cases, flag_deaths_gt_hosp
from weekwatch.sources.tables import write_parquet
from weekwatch.streaming import weekly as streaming

EVENT = "key int, ts timestamp"


def day(n, hour=0):
    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=n)


def through(spark, tmp_path, make, *batches):
    """Feed the batches one after the other; returns what has come out."""
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(src)
        stream = streaming.read_files(spark, src, spark.read.parquet(src).schema)
        streaming.run_available(make(stream), out, state)
    return spark.read.parquet(out)


def test_row_checks_equal_the_stored_ones(spark, prov, tmp_path):
    write_parquet(prov, f"{tmp_path}/in")
    stream = streaming.read_files(spark, f"{tmp_path}/in", prov.schema)
    streaming.run_available(
        streaming.check_rows(stream, WEEKLY_PROV), f"{tmp_path}/out", f"{tmp_path}/state"
    )
    stored = clamp_hosp_gt_cases(flag_deaths_gt_hosp(add_flags(prov, WEEKLY_PROV)))
    assert spark_rows(spark.read.parquet(f"{tmp_path}/out")) == spark_rows(stored)


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    out = through(
        spark,
        tmp_path,
        lambda s: streaming.drop_repeats(s, ["key"], "ts", "2 days"),
        [(1, day(0)), (1, day(0, 5)), (2, day(0))],
        [(1, day(1)), (3, day(1))],
    )
    assert sorted(r["key"] for r in out.collect()) == [1, 2, 3]


def test_weeks_start_on_monday_and_late_rows_are_cut_off(spark, tmp_path):
    out = through(
        spark,
        tmp_path,
        lambda s: streaming.weekly_counts(s, ["key"], "ts", "1 day"),
        [(1, day(0)), (1, day(6, 23)), (1, day(7)), (2, day(3))],
        [(1, day(20))],
        [(1, day(2)), (1, day(40))],
    )
    rows = {(r["key"], r["week_start"].isoformat()): r["n"] for r in out.collect()}
    assert rows == {
        (1, "2024-01-01"): 2,
        (2, "2024-01-01"): 1,
        (1, "2024-01-08"): 1,
        (1, "2024-01-15"): 1,
    }


def events(spark, path, files=None):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    if files:
        rows.repartition(files).write.parquet(path)
    else:
        rows.coalesce(1).write.parquet(path)


def test_events_in_many_files_equal_one_file(spark, sf_dir, tmp_path):
    events(spark, f"{tmp_path}/events.parquet", 260)
    for name in ("stream_event_repeats", "stream_event_weeks"):
        query = queries.queries()[name]
        assert spark_rows(query(spark, str(tmp_path))) == spark_rows(query(spark, sf_dir))


def test_late_rows_are_counted_or_refused(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(rows, **settings):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(src)
        stream = streaming.read_files(spark, src, spark.read.parquet(src).schema)
        counted = streaming.weekly_counts(stream, ["key"], "ts", "1 day")
        return streaming.run_available(counted, out, state, **settings)

    assert arrive([(1, day(0))]) == 0
    assert arrive([(1, day(40))]) == 0
    assert arrive([(1, day(2)), (2, day(3))]) == 2
    with pytest.raises(streaming.LateRowsError, match="1 rows"):
        arrive([(1, day(4))], fail_on_late=True)
