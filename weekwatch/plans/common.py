"""What the jobs share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from weekwatch.sources.tables import scan_present
from weekwatch.specs import TableSpec

JOBS = 4


def together(*works: Callable[[], object]) -> list:
    """Run independent actions at the same time, so that small ones fill the gaps of large ones."""
    with ThreadPoolExecutor(max_workers=len(works)) as pool:
        return [future.result() for future in [pool.submit(work) for work in works]]


R = TypeVar("R")


def each_table(
    spark: SparkSession,
    folder: str,
    specs: Sequence[TableSpec],
    work: Callable[[DataFrame, TableSpec], R],
    jobs: int = JOBS,
) -> tuple[dict[str, R], list[str]]:
    """Run ``work`` on every table that is there, some at a time.

    Returns the results by table name, in the order of the specs, and the names
    of the tables that were skipped because they are missing.
    """
    tables = scan_present(spark, folder, specs)
    present = [(df, spec) for spec, df in tables if df is not None]
    with ThreadPoolExecutor(max_workers=jobs) as pool:
        results = list(pool.map(lambda pair: work(*pair), present))
    done = {spec.name: result for (_, spec), result in zip(present, results)}
    return done, [spec.name for spec, df in tables if df is None]
