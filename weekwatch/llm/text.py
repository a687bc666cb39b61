"""Columns that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekwatch.functions.ordered import attach
from weekwatch.sources.scratch import store

# The white space between words, and what counts as a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by ``folds``.

    A null id counts as the empty text.
    """
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0


def unit_hash(*columns: Column, hex_digits: int = 15) -> Column:
    """A whole number from the first hex digits of the md5 of the columns, joined by ':'."""
    joined = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(joined), 1, hex_digits), 16, 10).cast("bigint")


def rows_that_stay(docs: DataFrame, decided: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; ``decided`` has ``keys`` and ``kept``, a row per row.

    ``keys`` are columns of ``docs`` by the name that they have in ``decided``. Rows with equal keys are one: the one
    with the smallest hash of all its columns stays, if any of them is kept. Rows that stay for sure are not moved:
    only what is dropped or repeated is joined to them, by a broadcast while it is small.
    """
    names = list(keys)
    found = decided.groupBy(*names).agg(F.bool_or("kept").alias("__stays"), F.count("*").alias("__rows"))
    odd = store(found.where("not __stays or __rows > 1").select(*names, "__stays"), "odd")
    counts = odd.agg(F.count("*").alias("rows"), F.count_if("__stays").alias("repeated")).first()
    packed = docs.select(F.struct("*").alias("doc"), *(c.alias(f"__key_{n}") for n, c in keys.items()))
    odd = odd.withColumnsRenamed({n: f"__key_{n}" for n in names})
    marked = attach(packed, odd, [f"__key_{n}" for n in names], counts["rows"])
    stay = marked.where(F.col("__stays").isNull()).select("doc.*")
    if not counts["repeated"]:
        return stay
    row = F.xxhash64(*(F.col("doc")[c] for c in docs.columns))
    once = marked.where("__stays").groupBy(*(f"__key_{n}" for n in names)).agg(F.min_by("doc", row).alias("doc"))
    return stay.union(once.select("doc.*"))
