"""Validation of tables that grow by files."""

import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from fixtures.weekly import WEEKLY_PROV
from weekwatch.operators import profile
from weekwatch.plans import increment
from weekwatch.plans.increment import validate_increment
from weekwatch.plans.validation import validate

# All other findings are read off these.
FINDINGS = ["cells", "duplicates"]


def same(found, whole):
    for name in FINDINGS:
        assert spark_rows(getattr(found, name)) == spark_rows(getattr(whole, name)), name


def parts(prov, n=3):
    return [prov.where(F.pmod(F.xxhash64("ubigeo", "semana"), F.lit(n)) == i) for i in range(n)]


@pytest.fixture
def place(tmp_path):
    return f"{tmp_path}/t.parquet", f"{tmp_path}/kept"


def rows_counted(spark, kept):
    return spark.read.parquet(f"{kept}/cells").agg(F.sum("n_rows")).first()[0]


def test_files_are_counted_once(spark, prov, place):
    path, kept = place
    for i, part in enumerate(parts(prov, 2)):
        part.coalesce(2).write.mode("append").parquet(path)
        found = validate_increment(spark, path, WEEKLY_PROV, kept)
        there = spark.read.parquet(path)
        same(found, validate(there, WEEKLY_PROV))
        assert rows_counted(spark, kept) == there.count()
        assert spark.read.parquet(f"{kept}/files").agg(F.max("batch")).first()[0] == i
    again, whole = validate_increment(spark, path, WEEKLY_PROV, kept), validate(prov, WEEKLY_PROV)
    same(again, whole)
    assert spark_rows(again.overview) == spark_rows(whole.overview)
    assert rows_counted(spark, kept) == prov.count()


def test_keys_repeated_across_files(spark, prov, place):
    path, kept = place
    for _ in range(2):
        prov.coalesce(2).write.mode("append").parquet(path)
        found = validate_increment(spark, path, WEEKLY_PROV, kept)
    alone = profile.duplicate_count(prov, WEEKLY_PROV.key_cols).first()[0]
    keys = prov.select(*WEEKLY_PROV.key_cols).distinct().count()
    assert found.duplicates.first()[0] == 2 * alone + keys


def test_replaced_and_removed_files(spark, prov, place, tmp_path):
    path, kept = place
    first, second, third = parts(prov)
    first.coalesce(1).write.parquet(path)
    validate_increment(spark, path, WEEKLY_PROV, kept)
    before = {f for f in (tmp_path / "t.parquet").glob("*.parquet")}
    second.coalesce(1).write.mode("append").parquet(path)
    for gone in before:
        gone.unlink()
        (gone.parent / f".{gone.name}.crc").unlink()
    same(validate_increment(spark, path, WEEKLY_PROV, kept), validate(second, WEEKLY_PROV))
    third.coalesce(1).write.mode("overwrite").parquet(path)
    same(validate_increment(spark, path, WEEKLY_PROV, kept), validate(third, WEEKLY_PROV))


def test_a_run_that_fails_counts_nothing(spark, prov, place, monkeypatch):
    path, kept = place
    first, second, _ = parts(prov)
    first.coalesce(1).write.parquet(path)
    validate_increment(spark, path, WEEKLY_PROV, kept)
    second.coalesce(1).write.mode("append").parquet(path)

    def put(self, cells, keys, files):
        self.cells.put(cells, self.next_batch())
        raise RuntimeError("ended")

    with monkeypatch.context() as broken:
        broken.setattr(increment.KeptCounts, "put", put)
        with pytest.raises(RuntimeError):
            validate_increment(spark, path, WEEKLY_PROV, kept)
    same(validate_increment(spark, path, WEEKLY_PROV, kept), validate(first.union(second), WEEKLY_PROV))
    assert rows_counted(spark, kept) == first.union(second).count()


def test_only_new_files_are_read(spark, prov, place):
    path, kept = place
    first, second, _ = parts(prov)
    first.coalesce(1).write.parquet(path)
    old = {r["file"] for r in increment.files_of(spark, path).collect()}
    second.coalesce(1).write.mode("append").parquet(path)
    new = [r["file"] for r in increment.files_of(spark, path).collect() if r["file"] not in old]
    read = spark.read.parquet(path).where(F.col("_metadata.file_path").isin(new))
    assert {r[0] for r in read.select("_metadata.file_path").distinct().collect()} == set(new)
    assert read.rdd.getNumPartitions() == 1 and read.count() == second.count()


def test_empty_tables_and_clashing_names(spark, prov, place):
    path, kept = place
    prov.limit(0).write.parquet(path)
    found = validate_increment(spark, path, WEEKLY_PROV, kept)
    assert found.totals.first()["n_rows"] == 0 and found.duplicates.first()[0] == 0
    prov.withColumn("file", F.lit("x")).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="file"):
        validate_increment(spark, path, WEEKLY_PROV, kept)
