"""Run a job: ``python -m weekwatch validate --raw DIR --reports DIR`` (or through spark-submit)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from weekwatch.plans.cleaning import run_cleaning
from weekwatch.plans.detection import run_detection
from weekwatch.plans.validation import run_validation
from weekwatch.sources.jdbc_source import JdbcSource
from weekwatch.sources.snapshot import snapshot_tables


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="weekwatch", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("validate", "clean", "detect"):
        job = jobs.add_parser(name)
        job.add_argument("--raw", required=True, help="folder of the Parquet tables")
        job.add_argument("--reports", required=True, help="folder for the findings")
        if name == "clean":
            job.add_argument("--processed", required=True, help="folder for the cleaned tables")
    copy = jobs.add_parser("snapshot")
    copy.add_argument("--url", required=True, help="JDBC address of the database")
    copy.add_argument("--properties", required=True, help="JSON file with user, password, driver")
    copy.add_argument("--schema", default="public")
    copy.add_argument("--partitions", type=int, default=64, help="ranges read at a time per table")
    copy.add_argument("--raw", required=True, help="folder for the Parquet tables")
    copy.add_argument("--force", action="store_true", help="copy tables that are already there")
    return parser.parse_args(argv)


def show_all(report: DataFrame, vertical: bool = False) -> None:
    """Print a report whole: it has one row per table, or one per method."""
    report.show(max(1, report.count()), truncate=False, vertical=vertical)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    missing: list[str] = []
    if args.job == "validate":
        result, missing = run_validation(spark, args.raw, args.reports)
    elif args.job == "clean":
        result, missing = run_cleaning(spark, args.raw, args.processed, args.reports)
    elif args.job == "detect":
        found, missing = run_detection(spark, args.raw, args.reports)
        for detection in found.values():
            show_all(detection.totals)
        result = None
    else:
        with open(args.properties, encoding="utf-8") as file:
            properties = json.load(file)
        source = JdbcSource(spark, args.url, properties, args.schema, args.partitions)
        result = snapshot_tables(spark, source, args.raw, force=args.force)
    if result is not None:
        show_all(result, vertical=args.job == "validate")
    for name in missing:
        print(f"no table {name}, skipped")


if __name__ == "__main__":
    run(SparkSession.builder.appName("weekwatch").getOrCreate(), arguments())
