"""Best-fit packing into bins of several permitted lengths.

Pieces of equal length are alike, so the packing is planned over a histogram of lengths, which has at
most as many rows as the longest bin has words, whatever the number of documents. The plan says, for
each length, which bins its first, second, ... pieces go to; pieces are numbered without sorting all
of one length in one task, and look their bins up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekwatch.llm.text import WORD, whole
from weekwatch.sources.scratch import store

LENGTHS = (512, 1024, 2048, 4096)
# The longest bin may have at most so many words: the histogram has no more rows.
MAX_LENGTH = 65_536
# About so many pieces are numbered by one task.
NUMBERED = 200_000

# One line of a plan: ``n`` pieces of ``length`` from number ``first`` on go to bins from ``bin`` on,
# ``each`` to a bin, behind the ``filled`` words that these bins hold already.
PLAN = ("length", "first", "n", "bin", "each", "filled")


def _cheapest(length: int, lengths: Sequence[int]) -> int:
    """The bin to open for a piece: least cost per word if filled with such pieces, the longer if equal."""
    return min((c for c in lengths if c >= length), key=lambda c: (c / (c // length * length), -c))


def plan_bins(histogram: Sequence[tuple[int, int]], lengths: Sequence[int]) -> tuple[list[tuple], list[tuple]]:
    """Pack ``n`` pieces of each length, longest first, each into the bin it leaves least room in.

    Of bins with equal room the earliest is taken. Where none has room, a bin of the least-cost length is opened. At last each bin shrinks to the
    shortest permitted length that holds it. Bins alike are handled together, so the work depends
    on the number of lengths. Returns the plan and ``(first bin, bins, length)`` of all bins.
    """
    plan, open_bins = [], {}  # room left -> list of (first bin, bins, words held)
    next_bin = 0

    def put(length: int, first: int, left: int, room: int, group: tuple[int, int, int]) -> int:
        """Fill a group of like bins with pieces of one length; returns how many went in."""
        bin_, bins, held = group
        each = room // length
        full = min(bins, left // each)
        if full:
            plan.append((length, first, full * each, bin_, each, held))
            open_bins.setdefault(room - each * length, []).append((bin_, full, held + each * length))
        rest = left - full * each
        if rest and full < bins:
            plan.append((length, first + full * each, rest, bin_ + full, rest, held))
            open_bins.setdefault(room - rest * length, []).append((bin_ + full, 1, held + rest * length))
            full, rest = full + 1, 0
        if full < bins:
            open_bins.setdefault(room, []).append((bin_ + full, bins - full, held))
        return left - rest

    for length, n in sorted(histogram, reverse=True):
        first, left = 0, n
        for room in sorted(r for r in open_bins if r >= length):
            for group in sorted(open_bins.pop(room)) if left else []:
                if left:
                    went = put(length, first, left, room, group)
                    first, left = first + went, left - went
                else:
                    open_bins.setdefault(room, []).append(group)
        if left:
            size = _cheapest(length, lengths)
            bins = -(-left // (size // length))
            put(length, first, left, size, (next_bin, bins, 0))
            next_bin += bins
    bins = [
        (bin_, many, min(c for c in lengths if c >= held))
        for groups in open_bins.values()
        for bin_, many, held in groups
    ]
    return plan, sorted(bins)


def pieces(docs: DataFrame, longest: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, piece, start, length``: each text in pieces of at most ``longest`` words."""
    words = F.regexp_count(whole(text_col), F.lit(WORD)).cast("bigint")
    sized = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("words") - 1, F.lit(longest).cast("bigint"))
    return (
        sized.where("words > 0")
        .select("doc_id", "words", F.posexplode(starts).alias("piece", "start"))
        .select("doc_id", "piece", "start", F.least(F.lit(longest), F.col("words") - F.col("start")).alias("length"))
    )


def numbered(rows: DataFrame, histogram: Sequence[tuple[int, int]]) -> DataFrame:
    """Number the pieces of each length from 0, in groups that hash into about ``NUMBERED`` rows.

    A group starts where those before it end, so one length may be most of the table.
    """
    groups = max(1, -(-max((n for _, n in histogram), default=1) // NUMBERED)) * 4
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("row")
    return (
        dealt.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, ["length", "part"])
        .withColumn("number", F.col("before") + F.col("at"))
        .drop("part", "at", "before")
    )


PACKED = "doc_id long, piece int, start long, length long, bin long, bin_length long, bin_start long"


def pack(
    docs: DataFrame, lengths: Sequence[int] = LENGTHS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Where each piece of each text goes: its ``start`` and ``length`` in words, its ``bin``, the
    bin's final ``bin_length``, and ``bin_start``, its place in the bin.

    A text longer than the longest bin is cut into pieces of that length and a rest. Null and empty
    texts, and texts of white space, have no words and no piece. Repeated rows are packed each for
    themselves. No table has more bins than pieces; an empty table has none. Pieces of one length
    are interchangeable: which of them shares which bin follows from the stored table of pieces.
    """
    lengths = sorted(set(lengths))
    if not lengths or lengths[0] < 1 or lengths[-1] > MAX_LENGTH:
        raise ValueError(f"lengths of bins must lie between 1 and {MAX_LENGTH}")
    rows = pieces(docs, lengths[-1], id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    rows = store(rows, "pieces")
    # One row per length, at most as many as the longest bin has words.
    histogram = [(r["length"], r["count"]) for r in rows.groupBy("length").count().collect()]
    plan, bins = plan_bins(histogram, lengths)
    plan.sort(key=lambda line: (line[0], line[1]))
    lines = {name: np.array([line[i] for line in plan], np.int64) for i, name in enumerate(PLAN)}
    bin_first = np.array([b for b, _, _ in bins], np.int64)
    bin_size = np.array([c for _, _, c in bins], np.int64)
    # Lines are found by length and number at once.
    order = np.rec.fromarrays([lines["length"], lines["first"]])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, number = batch["length"].to_numpy(np.int64), batch["number"].to_numpy(np.int64)
            wanted = np.rec.fromarrays([length, number], dtype=order.dtype)
            at = np.searchsorted(order, wanted, side="right") - 1
            past = number - lines["first"][at]
            batch["bin"] = lines["bin"][at] + past // lines["each"][at]
            batch["bin_start"] = lines["filled"][at] + past % lines["each"][at] * length
            batch["bin_length"] = bin_size[np.searchsorted(bin_first, batch["bin"], side="right") - 1]
            yield batch[["doc_id", "piece", "start", "length", "bin", "bin_length", "bin_start"]]

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return numbered(rows, histogram).mapInPandas(place, PACKED.replace("doc_id long", f"doc_id {id_type}"))
