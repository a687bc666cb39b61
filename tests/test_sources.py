import math

import pytest

from frames import SPEC, table
from weekwatch.sources import scratch
from weekwatch.sources.jdbc_source import JdbcSource, quoted
from weekwatch.sources.parquet_source import ParquetSource
from weekwatch.sources.snapshot import snapshot_tables
from weekwatch.sources.tables import (
    conform,
    path_exists,
    read_csv,
    scan_present,
    table_complete,
    write_csv,
    write_parquet,
)


@pytest.fixture
def folder(spark, tmp_path):
    src = tmp_path / "src"
    write_parquet(spark.range(7), f"{src}/a.parquet")
    write_parquet(spark.range(3), f"{src}/b.parquet")
    return str(src)


class Odd(ParquetSource):
    """A source whose tables fail without a text, or lose rows on the way."""

    def read(self, table):
        if table == "a":
            raise RuntimeError
        return super().read(table).limit(1)


def statuses(df):
    return {r["table"]: (r["status"], r["rows"]) for r in df.collect()}


def test_snapshot_copies_then_skips_then_overwrites(spark, folder, tmp_path):
    out, source = str(tmp_path / "out"), ParquetSource(spark, folder)
    written = {"a": ("written", 7), "b": ("written", 3)}
    assert statuses(snapshot_tables(spark, source, out)) == written
    skipped = {"a": ("skipped", None), "b": ("skipped", None)}
    assert statuses(snapshot_tables(spark, source, out)) == skipped
    assert statuses(snapshot_tables(spark, source, out, force=True)) == written
    assert spark.read.parquet(f"{out}/a.parquet").count() == 7


def test_unfinished_copy_is_done_again(spark, folder, tmp_path):
    out, source = tmp_path / "out", ParquetSource(spark, folder)
    snapshot_tables(spark, source, str(out), ["a"])
    (out / "a.parquet" / "_SUCCESS").unlink()
    assert not table_complete(spark, f"{out}/a.parquet")
    assert statuses(snapshot_tables(spark, source, str(out), ["a"])) == {"a": ("written", 7)}


def test_one_bad_table_does_not_stop_the_others(spark, folder, tmp_path):
    done = snapshot_tables(spark, ParquetSource(spark, folder), str(tmp_path / "o"), ["a", "x", "b"])
    rows = {r["table"]: r for r in done.collect()}
    assert [rows[t]["status"] for t in "axb"] == ["written", "error", "written"]
    assert rows["x"]["error"] and rows["x"]["rows"] is None


def test_errors_without_text_and_short_copies_are_reported(spark, folder, tmp_path):
    done = {r["table"]: r for r in snapshot_tables(spark, Odd(spark, folder), str(tmp_path / "o")).collect()}
    assert (done["a"]["status"], done["a"]["error"]) == ("error", "RuntimeError: ")
    b = done["b"]
    assert (b["status"], b["rows"], b["source_rows"]) == ("error", 1, 3)
    assert "3 in the source" in b["error"] and b["seconds"] > 0


def test_no_tables(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    source = ParquetSource(spark, str(tmp_path / "empty"))
    assert snapshot_tables(spark, source, str(tmp_path / "o")).count() == 0


def test_jdbc_pages():
    source = JdbcSource(None, "jdbc:postgresql://host/db", {"user": "u"}, partitions=3)
    assert quoted('we"ird') == '"we""ird"'
    assert source._name("t") == '"public"."t"'
    assert "pg_relation_size('\"public\".\"it''s\"'::regclass)" in source.pages_query("it's")
    assert source.page_predicates(90) == [
        "ctid >= '(0,0)'::tid and ctid < '(30,0)'::tid",
        "ctid >= '(30,0)'::tid and ctid < '(60,0)'::tid",
        "ctid >= '(60,0)'::tid",
    ]
    assert source.page_predicates(0) == ["ctid >= '(0,0)'::tid"]


class Counted(JdbcSource):
    """Answers queries from a table of this session instead of a database."""

    def _reader(self, **options):
        sql = options["query"].replace('"public".', "").replace('"', "`")
        spark = self.spark

        class Reader:
            load = staticmethod(lambda: spark.sql(sql))

        return Reader


@pytest.mark.parametrize("columns", ["ano, code, day", "code", "ano, day"])
def test_jdbc_ranges_part_any_table(spark, columns):
    rows = spark.range(1000).selectExpr(
        "cast(2000 + id % 25 as int) as ano",
        "if(id % 50 = 7, null, concat('it''s ', id % 300)) as code",
        "date_add(date'2020-01-01', cast(id % 200 as int)) as day",
    )
    table_ = rows.selectExpr(*columns.split(", "))
    table_.createOrReplaceTempView("ranged")
    source = Counted(spark, "jdbc:other://host/db", {}, partitions=8)
    parts = source.predicates("ranged", table_.schema)
    assert len(parts) == 8
    sql = [p.replace('"', "`").replace("''", "\\'") for p in parts]
    sizes = [table_.where(p).count() for p in sql]
    assert sum(sizes) == 1000 and min(sizes) >= 100
    source.split_columns = {"ranged": columns.split(", ")[0]}
    assert source.split_column("ranged", table_.schema) == columns.split(", ")[0]


def test_jdbc_table_without_an_ordered_column_is_one_part(spark):
    source = Counted(spark, "jdbc:other://host/db", {})
    assert source.predicates("t", spark.createDataFrame([], "a boolean, b double").schema) is None
    assert source.range_predicates("a", [3, 3]) == ["1 = 1"]


def test_conform_fails_on_missing_columns(spark):
    with pytest.raises(ValueError, match="hosp_total"):
        conform(table(spark, {}).drop("hosp_total"), SPEC)


def test_conform_types(spark):
    spec = SPEC.with_(metrics=(*SPEC.metrics, "rate"))
    rows = table(spark, {}, {}).selectExpr(
        "* except (week_start, cases_total)",
        "cast(week_start as timestamp) as week_start",
        "cast(cases_total as int) as cases_total",
        "cast('NaN' as double) as rate",
    )
    out = conform(rows, spec)
    kinds = dict(out.dtypes)
    assert (kinds["week_start"], kinds["cases_total"], kinds["rate"]) == ("date", "bigint", "double")
    assert out.first()["rate"] is None
    assert math.isnan(rows.first()["rate"])


def test_missing_tables_are_named(spark, tmp_path):
    write_parquet(table(spark, {}), f"{tmp_path}/tiny.parquet")
    pairs = scan_present(spark, str(tmp_path), [SPEC, SPEC.with_(name="gone")])
    assert [(spec.name, df is not None) for spec, df in pairs] == [("tiny", True), ("gone", False)]


def test_csv_keeps_values_and_header(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1, None), ('q"', None, 2.5)], "s string, i int, d double")
    write_csv(df, f"{tmp_path}/t.csv")
    back = read_csv(spark, f"{tmp_path}/t.csv", df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert spark.read.text(f"{tmp_path}/t.csv").filter("value = 's,i,d'").count() >= 1


def test_scratch_is_the_folder_the_session_names(spark):
    named = spark.conf.get(scratch.CHECKPOINT_CONF)
    assert scratch.scratch_dir(spark) == named
    stored = scratch.store(spark.range(5), "numbers")
    assert stored.count() == 5
    assert all(f.startswith(f"file://{named}") for f in stored.inputFiles())


def test_scratch_without_a_named_folder():
    class Session:
        conf = {scratch.WAREHOUSE_CONF: "s3a://lake/warehouse/"}

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    assert scratch.scratch_dir(Session) == "s3a://lake/warehouse/_scratch"
    Session.conf[scratch.CHECKPOINT_CONF] = "s3a://lake/checkpoints"
    assert scratch.scratch_dir(Session) == "s3a://lake/checkpoints"


def test_a_job_leaves_nothing_behind(spark):
    with scratch.job_folder(spark) as folder:
        assert scratch.store(spark.range(3), "n", folder).count() == 3
        assert path_exists(spark, folder)
    assert not path_exists(spark, folder)


def test_a_table_half_written_is_refused(spark, tmp_path):
    write_parquet(table(spark, {}), f"{tmp_path}/tiny.parquet")
    (tmp_path / "tiny.parquet" / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="never finished"):
        scan_present(spark, str(tmp_path), [SPEC])


def test_paths(spark, tmp_path):
    assert not path_exists(spark, f"{tmp_path}/none")
    assert path_exists(spark, str(tmp_path))
