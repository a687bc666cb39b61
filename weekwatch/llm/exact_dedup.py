"""Exact deduplication through counting quotient filters.

Each task builds small counting quotient filters of the 64-bit fingerprints of its texts, one per
range of fingerprints. Filters of the same range merge without loss, since both are sorted. Only
fingerprints that occur more than once send their texts on to a comparison byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.functions.ordered import attach
from weekwatch.llm.text import SPACE, rows_that_stay, whole
from weekwatch.sources.scratch import store

# At most so many fingerprints are held by a task before it hands on its filters.
BUFFERED = 1_000_000
# About so many rows meet in the merge of one range.
RANGE_ROWS = 250_000
# At most so many fingerprints or classes are broadcast; beyond them rows are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def normalised(text: str | Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(whole(text), SPACE, " ")


# ---- the filter -------------------------------------------------------------------------------


def build_filter(sorted_prints: np.ndarray, counts: np.ndarray) -> dict:
    """A counting quotient filter of distinct sorted 64-bit fingerprints and their counts.

    A fingerprint is split into a quotient of ``q`` bits, the slot it belongs to, and a remainder.
    ``occupied`` has a bit for each quotient, ``run_end`` one for each slot: set where the run of
    a quotient ends. Remainders are kept to the byte; counts only where they exceed one.
    """
    q = max(1, int(len(sorted_prints)).bit_length())
    width = -(-(64 - q) // 8)
    quotients = sorted_prints >> np.uint64(64 - q)
    remainders = sorted_prints & np.uint64((1 << (64 - q)) - 1)
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotients] = True
    run_end = np.ones(len(sorted_prints), dtype=bool)
    run_end[:-1] = quotients[1:] != quotients[:-1]
    repeated = counts > 1
    stored = remainders.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    return {
        "n": len(sorted_prints),
        "q": q,
        "occupied": np.packbits(occupied).tobytes(),
        "run_end": np.packbits(run_end).tobytes(),
        "remainders": stored.tobytes(),
        "repeated": np.packbits(repeated).tobytes(),
        "counts": counts[repeated].astype("<u8").tobytes(),
    }


def read_filter(f: dict) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter and their counts."""
    n, q = int(f["n"]), int(f["q"])
    width = -(-(64 - q) // 8)
    bits = lambda name, size: np.unpackbits(np.frombuffer(f[name], np.uint8), count=size).astype(bool)
    run = np.concatenate([[0], np.cumsum(bits("run_end", n))[:-1]]).astype(np.int64)
    quotients = np.flatnonzero(bits("occupied", 1 << q))[run].astype(np.uint64)
    padded = np.zeros((n, 8), np.uint8)
    padded[:, 8 - width :] = np.frombuffer(f["remainders"], np.uint8).reshape(n, width)
    prints = (quotients << np.uint64(64 - q)) | padded.reshape(-1).view(">u8").astype(np.uint64)
    counts = np.ones(n, np.int64)
    counts[bits("repeated", n)] = np.frombuffer(f["counts"], "<u8").astype(np.int64)
    return prints, counts


def merge_sorted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of fingerprints with counts as one; equal fingerprints add up."""
    (prints, counts), (others, more) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    at = np.searchsorted(prints, others)
    known = at < len(prints)
    known[known] = prints[at[known]] == others[known]
    counts = counts.copy()
    counts[at[known]] += more[known]
    return np.insert(prints, at[~known], others[~known]), np.insert(counts, at[~known], more[~known])


def merge_filters(filters: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of all filters in order, with their counts added up, merged two by two."""
    read = [read_filter(f) for f in filters]
    while len(read) > 1:
        pairs = [merge_sorted(*read[i : i + 2]) for i in range(0, len(read) - 1, 2)]
        read = pairs + read[len(read) // 2 * 2 :]
    return read[0]


FILTER_SCHEMA = (
    "part int, n bigint, q int, occupied binary, run_end binary, remainders binary, "
    "repeated binary, counts binary"
)


def partition_filters(prints: DataFrame, range_bits: int) -> DataFrame:
    """One row per task and range: the counting quotient filter of ``print`` in that range."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(held: list[np.ndarray]) -> pd.DataFrame:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            parts = (found >> np.uint64(63 - range_bits) >> np.uint64(1)).astype(np.int64)
            at = np.flatnonzero(np.diff(parts, prepend=-1))
            return pd.DataFrame(
                [
                    {"part": int(parts[a])} | build_filter(found[a:b], counts[a:b])
                    for a, b in zip(at, [*at[1:], len(found)], strict=True)
                ]
            )

        held, size = [], 0
        for batch in batches:
            held.append(batch["print"].to_numpy(np.int64).view(np.uint64))
            size += len(batch)
            if size >= BUFFERED:
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    return prints.mapInPandas(build, FILTER_SCHEMA)


def repeated_prints(prints: DataFrame, range_bits: int) -> DataFrame:
    """``print`` and ``n`` of every fingerprint that occurs more than once.

    A range holds a bounded number of distinct fingerprints however often each occurs.
    """

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        found, counts = merge_filters(part.to_dict("records"))
        more = counts > 1
        return pd.DataFrame({"print": found[more].view(np.int64), "n": counts[more]})

    filters = partition_filters(prints, range_bits)
    return filters.groupBy("part").applyInPandas(merge, "print bigint, n bigint")


# ---- the operator -----------------------------------------------------------------------------


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which rows hold equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their ``normalised`` forms are, byte by byte. Of equal texts the row with
    the smallest id stays; a null id comes last. Of repeated rows with that same id one stays. Null
    texts are empty texts. One row comes out per row; an empty table gives none. Other columns of
    ``docs`` are not read, whatever their names.

    The narrow table of ids and fingerprints is written once to the shared folder. Whole texts are moved
    only where their fingerprint occurs more than once, which each task tells by a broadcast of those
    fingerprints, while they are at most ``BROADCAST_ROWS``; beyond, texts meet them by a shuffle.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    texts = texts.withColumn("print", F.xxhash64("norm"))
    narrow = store(
        texts.select("doc_id", "print", F.sha2("norm", 256).alias("sha")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "prints",
    )
    range_bits = max(4, math.ceil(math.log2(max(1, narrow.count() / RANGE_ROWS))))
    repeated = store(repeated_prints(narrow.select("print"), range_bits).select("print"), "repeated")

    # Grouping by the text itself compares the bytes; copies within a task collapse before the shuffle.
    equal = (
        texts.join(_small(repeated), "print", "left_semi")
        .groupBy("norm")
        .agg(F.count("*").alias("copies"), F.any_value("print").alias("print"))
        .where("copies > 1")
        .select("print", F.sha2("norm", 256).alias("sha"))
    )
    equal = store(equal, "equal")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    classes = (
        narrow.join(_small(equal), ["print", "sha"], "left_semi")
        .groupBy("print", "sha")
        .agg(F.min(order).alias("first"), F.count("*").alias("size"))
    )
    classes = store(classes, "classes")
    alone = F.col("size").isNull()
    return attach(narrow, classes, ["print", "sha"]).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _small(table: DataFrame) -> DataFrame:
    """The stored table, broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows repeated with the same id and text are one; of those with other columns the same one stays in every run.
    """
    groups = exact_groups(docs, id_col, text_col)
    keys = {"doc_id": F.col(id_col), "text_sha256": F.sha2(normalised(text_col), 256)}
    return rows_that_stay(docs, groups, keys)
