"""Cleaning of a set of tables, and the under-reporting table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekwatch.operators import silence
from weekwatch.operators.cleaning import clean_table, cleaning_audit
from weekwatch.plans.common import each_table, together
from weekwatch.sources.scratch import job_folder, store
from weekwatch.sources.tables import read_csv, write_csv, write_parquet
from weekwatch.specs import SURVEILLANCE, TableSpec


def run_cleaning(
    spark: SparkSession,
    raw_dir: str,
    processed_dir: str,
    report_dir: str,
    specs: Sequence[TableSpec] = SURVEILLANCE,
) -> tuple[DataFrame | None, list[str]]:
    """Clean the tables in a folder that have a natural key; the raw ones stay as they are.

    Writes the cleaned tables, sorted by key within each file, the audit, and the
    silence table. Returns the written audit and the names of missing tables;
    intermediate tables are removed.
    """

    def clean(df: DataFrame, spec: TableSpec) -> DataFrame:
        path = f"{processed_dir}/{spec.name}_cleaned.parquet"
        cleaned = clean_table(df, spec)
        write_parquet(cleaned.sortWithinPartitions(*spec.natural_key), path)
        written = spark.read.schema(cleaned.schema).parquet(path)
        return cleaning_audit(df, written, spec.name)

    def report_silence(df: DataFrame, spec: TableSpec, scratch: str) -> None:
        keys = spec.silence_keys
        report = store(silence.silence_report(df, keys, spec), f"silence-{spec.name}", scratch)
        ordered = report.orderBy(F.desc("pct_silence"), *keys)
        top = silence.trend_reading(silence.top_silent(report, keys))
        write_csv(ordered, f"{report_dir}/silence_by_{keys[-1]}.csv")
        write_csv(top, f"{report_dir}/silence_top_{keys[-1]}.csv")

    def work(df: DataFrame, spec: TableSpec, scratch: str) -> DataFrame:
        works = [lambda: clean(df, spec)]
        if spec.silence_keys:
            works.append(lambda: report_silence(df, spec, scratch))
        audit, *_ = together(*works)
        return audit

    wanted = [spec for spec in specs if spec.natural_key]
    with job_folder(spark) as scratch:
        done, missing = each_table(spark, raw_dir, wanted, lambda df, spec: work(df, spec, scratch))
    if not done:
        return None, missing
    audit = reduce(DataFrame.unionByName, done.values())
    path = f"{report_dir}/cleaning_report.csv"
    write_csv(audit, path)
    return read_csv(spark, path, audit.schema), missing
