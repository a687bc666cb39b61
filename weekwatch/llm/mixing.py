"""Mix sources to target weights by nested hash thresholds.

A document's place is a fixed hash of its id and text. Per source, tokens are added up by hash
bucket; the bucket in which the budget runs out is divided again by the next bits of the hash, and
so on. What lies below the final threshold is taken once more. Nothing is sorted but the buckets, and
rows are compared with their source's threshold where they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekwatch.functions.ordered import attach
from weekwatch.llm.text import WORD, unit_hash, whole
from weekwatch.sources.scratch import store

# Bits of the hash that each level of buckets reads, and the number of levels.
LEVEL_BITS = 12
LEVELS = 3
HASH_DIGITS = LEVEL_BITS * LEVELS // 4


def place(id_col: str, text_col: str) -> Column:
    return unit_hash(F.col(id_col), F.col(text_col), hex_digits=HASH_DIGITS)


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2
) -> DataFrame:
    """One row per ``source``: ``source_size``, its ``target``, and what of that whole repeats leave.

    ``sizes`` has ``source`` and ``size``. Sources in order of code points, null last, get the
    weights in turn. All sources stand in one ordered window, so there may be as many as a task sorts. They share ``share`` (a fraction) of all sizes by weight; a target stops at
    ``cap`` times its source, and the excess goes to the others by weight until none is above: with
    the sources in the order of their room per weight, those that stop come first.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1)
    room = (F.col("source_size") / F.col("weight")).alias("room")
    ranked = per_source.withColumn("weight", weight.cast("bigint")).withColumn("room", room)
    by_room = Window.orderBy("room", F.asc_nulls_last("source"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = F.sum("source_size").over(everything) * share[0]
    filled = ranked.withColumns(
        {
            "at": F.row_number().over(by_room),
            # Budget left to those from here on, over their weights, as one exact fraction.
            "left": shared - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * (cap * share[1]),
            "over": F.sum("weight").over(onwards) * share[1],
        }
    )
    stops = (F.col("left") * F.col("weight")) / F.col("over") > F.col("source_size") * cap
    level = F.max(F.when(~stops, F.struct((-F.col("at")).alias("at"), "left", "over"))).over(everything)
    target = F.when(stops, (F.col("source_size") * cap).cast("double")).otherwise(
        (F.col("level.left") * F.col("weight")) / F.col("level.over")
    )
    whole_repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        filled.withColumn("level", level)
        .select("source", "source_size", target.alias("target"))
        .withColumn("repeats", whole_repeats)
        .withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))
    )


def source_plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """What to take, one row per ``source``.

    ``rows`` has ``source, size, h``. A row is taken ``repeats`` times, and once more when its ``h``
    is at most ``last``. Only the boundary bucket of a source is looked at again.
    """
    bounds = None
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        cells = rows.withColumn("bucket", F.shiftright("h", shift))
        if bounds is not None:
            inside = F.shiftright("h", shift + LEVEL_BITS).alias("outer")
            known = bounds.select(F.col("source").alias("s"), F.col("bucket").alias("outer"), "below")
            cells = cells.withColumn("outer", inside)
            same = cells["source"].eqNullSafe(known["s"]) & (cells["outer"] == known["outer"])
            cells = cells.join(known, same).select("source", "bucket", "size", "below")
        else:
            cells = cells.select("source", "bucket", "size", F.lit(0).cast("bigint").alias("below"))
        cells = cells.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.max("below").alias("below"))
        upto = Window.partitionBy("source").orderBy("bucket")
        cells = cells.withColumn("upto", F.col("below") + F.sum("size").over(upto))
        goal = targets.select(F.col("source").alias("s"), "rest")
        bounds = (
            cells.join(goal, cells["source"].eqNullSafe(goal["s"]))
            .where((F.col("upto") - F.col("size") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
            .select("source", "bucket", (F.col("upto") - F.col("size")).alias("below"), "size", "rest")
        )
        bounds = store(bounds, f"bounds{level}")
    # The last cell is one value of the hash: in if that comes nearer to the budget.
    nearer = F.col("below") + F.col("size") / 2 <= F.col("rest")
    last = bounds.select(
        F.col("source").alias("s"), F.when(nearer, F.col("bucket")).otherwise(F.col("bucket") - 1).alias("last")
    )
    return targets.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", F.col("repeats").cast("bigint").alias("repeats"),
        F.coalesce("last", F.lit(-1)).cast("bigint").alias("last"),
    )


def _times(rows: DataFrame, plan: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows with ``source`` and ``h`` and how often each is taken: a comparison with their source's threshold.

    The plan is broadcast, unless there are very many sources; then rows meet it by a shuffle, spread by salts.
    """
    known = attach(rows, store(plan, "plan"), ["source"])
    times = F.col("repeats") + F.when(F.col("h") <= F.col("last"), 1).otherwise(0)
    return known.select(*keep, "source_size", "target", times.cast("bigint").alias("times"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(whole(text_col), F.lit(WORD)).cast("bigint").alias("size"),
        place(id_col, text_col).alias("h"),
    )
    return store(rows, "sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """How many words of each row the mix takes: ``doc_id, source, size, source_size, target, times, taken``.

    A null text has no words, a null source is a source. A row is taken whole, ``times`` times.
    Rows that repeat with the same id and text share a place, so all of them are in or out. Reruns
    agree, as the hash is fixed. An empty table gives an empty mix. Texts of any length are counted
    whole, and columns besides the three are not read.
    """
    rows = _sized(docs, id_col, text_col, source_col)
    targets = store(source_targets(rows, **shares), "targets")
    taken = (F.col("size") * F.col("times")).alias("taken")
    return _times(rows, source_plan(rows, targets), ["doc_id", "source", "size"]).select("*", taken)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with all their columns."""
    rows = _sized(docs, id_col, text_col, source_col)
    targets = store(source_targets(rows, **shares), "targets")
    packed = docs.select(
        F.struct("*").alias("doc"), F.col(source_col).alias("source"), place(id_col, text_col).alias("h")
    )
    times = F.col("times").cast("int")
    return (
        _times(packed, source_plan(rows, targets), ["doc"])
        .where("times > 0")
        .select("doc", F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
        .select("doc.*")
    )
