"""Folders put in place of others, batches written again, and streams that keep stored results up."""

import datetime

import pytest

from compare import spark_rows
from weekwatch.operators import cleaning, outliers
from weekwatch.sources import publish, snapshot
from weekwatch.sources.parquet_source import ParquetSource
from weekwatch.sources.tables import path_exists, write_parquet
from weekwatch.sources.upsert import UpsertTable
from weekwatch.streaming import stored, weekly

SERIES_FLAGS = "place string, day date, n bigint, n__iqr_low double, n__iqr_high double, n__is_iqr boolean"


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def count(spark, path):
    return spark.read.parquet(path).count() if path_exists(spark, path) else None


def test_publish_replaces_whole_folders(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    for rows in (3, 5):
        publish.stage(spark.range(rows), path)
        publish.publish(spark, path)
        assert count(spark, path) == rows
    with pytest.raises(ValueError, match="staged"):
        publish.publish(spark, path)
    assert count(spark, path) == 5


def test_a_job_that_ends_between_the_renames(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    write_parquet(spark.range(4), path)
    (tmp_path / "_former").mkdir()
    (tmp_path / "t.parquet").rename(tmp_path / "_former" / "t.parquet")
    publish.recover(spark, path)
    assert count(spark, path) == 4
    write_parquet(spark.range(9), f"{tmp_path}/_former/t.parquet")
    publish.recover(spark, path)
    assert count(spark, path) == 4 and not path_exists(spark, f"{tmp_path}/_former/t.parquet")


class Failing(ParquetSource):
    """A source whose rows fail while they are read."""

    def read(self, table):
        from pyspark.sql import functions as F

        return super().read(table).select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"))


def test_a_failed_copy_leaves_what_was_there(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    write_parquet(spark.range(6), f"{src}/a.parquet")
    snapshot.snapshot_tables(spark, ParquetSource(spark, src), out)
    failed = snapshot.snapshot_tables(spark, Failing(spark, src), out, force=True).first()
    assert failed["status"] == "error" and "broken" in failed["error"]
    assert count(spark, f"{out}/a.parquet") == 6
    assert not path_exists(spark, f"{out}/_staged/a.parquet")


def test_upserts(spark, tmp_path):
    rows = lambda *pairs: spark.createDataFrame(pairs, "k int, v string")
    table = UpsertTable(spark, f"{tmp_path}/t", rows((1, "a")).schema, ["k"])
    assert table.compacted() == -1 and table.latest().collect() == []
    table.compact()
    table.put(rows((1, "a"), (2, "b"), (None, "n")), 0)
    table.put(rows((2, "x"), (2, "y")), 1)
    table.put(rows((2, "c"), (2, "d")), 1)  # the same batch again
    table.put(rows((None, "m")), 3)
    wanted = {(1, "a"), (2, "c"), (2, "d"), (None, "m")}
    assert {tuple(r) for r in table.latest().collect()} == wanted
    table.compact()
    assert {tuple(r) for r in table.latest().collect()} == wanted and table.rows().count() == 4 and table.compacted() == 3
    table.put(rows((None, "m")), 3)  # comes again, and is in already
    table.put(rows((1, "z")), 4)
    assert {tuple(r) for r in table.latest().collect()} == wanted - {(1, "a")} | {(1, "z")}
    table.compact()
    assert table.rows().count() == 4 and table.compacted() == 4


def _flag(series):
    return outliers.flag_iqr(series, ["place"], ["n"])


def arriving(spark, tmp_path, rows, schema, name="in"):
    for i, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        yield i, weekly.read_files(spark, f"{tmp_path}/{name}", schema)


def test_series_follow_the_batches(spark, tmp_path):
    schema = "place string, day date, n bigint"
    batches = [
        [("a", day(d), 1) for d in range(20)] + [("b", day(0), 5)],
        [("a", day(3), 90), (None, day(1), 2)],
        [("b", day(d), 7) for d in range(9)] + [("a", day(0), 1)],
    ]
    live = stored.LiveSeries(spark, f"{tmp_path}/live", "place string", "day", ["n"], _flag, SERIES_FLAGS)
    seen = []
    for i, stream in arriving(spark, tmp_path, batches, schema):
        stored.keep_up(stream, live.add, f"{tmp_path}/state")
        seen += batches[i]
        whole = spark.createDataFrame(seen, schema).groupBy("place", "day").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
        assert spark_rows(live.series()) == spark_rows(whole)
        assert spark_rows(live.flags()) == spark_rows(_flag(whole))
    touched = live.flagged.rows().where("batch = 1").select("place").distinct()
    assert {r[0] for r in touched.collect()} == {"a", None}
    # A batch that comes again, before and after the parts are put together, changes nothing.
    again = spark.createDataFrame(batches[2], schema)
    live.add(again, 2)
    assert spark_rows(live.series()) == spark_rows(whole)
    live.compact()
    assert live.parts.rows().select("batch").distinct().count() == 1
    live.add(again, 2)
    assert spark_rows(live.series()) == spark_rows(whole) and spark_rows(live.flags()) == spark_rows(_flag(whole))


KEYED = "place string, day date, cases bigint, code int, note string"


def test_stream_deduplicates_as_the_batch_does(spark, tmp_path):
    batches = [
        [("a", day(0), 5, 2, "x"), ("a", day(0), None, 1, None), ("b", day(1), None, None, "q")],
        [("a", day(0), 9, 1, "w"), (None, day(2), 1, 1, "z"), ("b", day(1), 3, 4, "p")],
        [("a", day(0), 2, 0, "k"), (None, day(2), 7, None, "a")],
    ]
    result = None
    for _, stream in arriving(spark, tmp_path, batches, KEYED):
        once = stored.deduplicate_stream(stream, ["place", "day"], ["cases"], ["note"], "code", "day", "30 days")
        result = UpsertTable(spark, f"{tmp_path}/kept", once.schema, ["place", "day"])
        assert stored.keep_up(once, result.put, f"{tmp_path}/state", "update") == 0
    whole = spark.createDataFrame(sum(batches, []), KEYED)
    wanted = cleaning.deduplicate(whole, ["place", "day"], ["cases"], ["note"], "code")
    assert spark_rows(result.latest()) == spark_rows(wanted)


def test_late_rows_are_counted(spark, tmp_path):
    batches = [[("a", day(0), 1, 1, "x"), ("a", day(90), 1, 1, "x")], [("a", day(95), 1, 1, "x")], [("a", day(0), 8, 1, "y"), ("b", day(1), 8, 1, "y")]]
    late = 0
    for _, stream in arriving(spark, tmp_path, batches, KEYED):
        once = stored.deduplicate_stream(stream, ["place", "day"], ["cases"], ["note"], "code", "day", "10 days")
        table = UpsertTable(spark, f"{tmp_path}/kept", once.schema, ["place", "day"])
        late += stored.keep_up(once, table.put, f"{tmp_path}/state", "update")
    assert late == 2 and table.latest().count() == 3
    for _, stream in arriving(spark, tmp_path, [[("b", day(1), 8, 1, "y")]], KEYED):
        once = stored.deduplicate_stream(stream, ["place", "day"], ["cases"], ["note"], "code", "day", "10 days")
        with pytest.raises(weekly.LateRowsError):
            stored.keep_up(once, table.put, f"{tmp_path}/state", "update", fail_on_late=True)
