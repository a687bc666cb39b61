"""Cut-off values of groups of any length, from histograms that add up.

A first pass counts each group's values in bins of equal width; the bin in which the wanted rank lies is
known from a few thousand counts per group. Only the values of that bin are ranked, counted and over ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekwatch.functions.ordered import attach, running
from weekwatch.sources.scratch import store

BINS = 4096


def _bin(value: Column, bins: int) -> Column:
    """Larger values are never in smaller bins; all are in bin 0 where they are equal."""
    share = (value - F.col("__least")) / F.nullif(F.col("__most") - F.col("__least"), F.lit(0.0))
    return F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def cut_offs(rows: DataFrame, keys: Sequence[str], value: str, quantile: float, bins: int = BINS) -> DataFrame:
    """``keys, n, cut_off``: how many values a group has, and their quantile between the two nearest ranks.

    Values are finite numbers; nulls do not count, and a group of nulls has no row. Null keys are a group.
    Equal to an exact ``percentile``; no task holds a group's values.
    """
    keys = list(keys)
    values = rows.select(*keys, F.col(value).cast("double").alias("__value")).where(F.col("__value").isNotNull())
    ends = store(values.groupBy(*keys).agg(F.min("__value").alias("__least"), F.max("__value").alias("__most"),
                                           F.count(F.lit(1)).alias("n")), "ends")
    groups = ends.count()
    binned = lambda: attach(values, ends, keys, groups).withColumn("__bin", _bin(F.col("__value"), bins))
    counts = binned().groupBy(*keys, "n", "__bin").agg(
        F.count(F.lit(1)).alias("__size"), F.min("__value").alias("__low"), F.max("__value").alias("__high")
    )
    upto = F.sum("__size").over(Window.partitionBy(*keys).orderBy("__bin"))
    place = (F.col("n") - 1) * F.lit(float(quantile))
    ranked = counts.withColumn("__upto", upto).withColumns({"__before": F.col("__upto") - F.col("__size"), "__place": place})
    holds = lambda rank: (F.col("__before") <= rank) & (rank < F.col("__upto"))
    lower, upper = holds(F.floor("__place")), holds(F.ceil("__place"))
    # Where the two ranks lie in different bins, they are the last of one and the first of the other.
    bounds = store(
        ranked.groupBy(*keys, "n", "__place").agg(
            F.max(F.when(lower, F.col("__high"))).alias("__a"),
            F.max(F.when(upper, F.col("__low"))).alias("__b"),
            F.max(F.when(lower & upper & (F.col("__low") < F.col("__high")), F.col("__bin"))).alias("__open"),
            F.max(F.when(lower & upper, F.col("__before"))).alias("__skip"),
        ),
        "bounds",
    )
    opened = bounds.where(F.col("__open").isNotNull()).select(*keys, "__open", "__skip", "__place")
    inside = attach(binned().drop("n"), opened, keys, groups).where(F.col("__bin") == F.col("__open"))
    counted = inside.groupBy(*keys, "__skip", "__place", "__value").agg(F.count(F.lit(1)).alias("__times"))
    ordered = running(counted, keys, ["__value"], F.col("__times"))
    first = F.col("__skip") + F.col("__upto") - F.col("__times")
    has = lambda rank: (first <= rank) & (rank < F.col("__skip") + F.col("__upto"))
    refined = ordered.groupBy(*keys).agg(
        F.max(F.when(has(F.floor("__place")), F.col("__value"))).alias("__a2"),
        F.max(F.when(has(F.ceil("__place")), F.col("__value"))).alias("__b2"),
    )
    a, b = F.coalesce("__a2", "__a"), F.coalesce("__b2", "__b")
    between = (F.ceil("__place") - F.col("__place")) * a + (F.col("__place") - F.floor("__place")) * b
    found = attach(bounds, refined, keys, groups)
    return found.select(*keys, "n", F.when(a == b, a).otherwise(between).alias("cut_off"))


def flag_top_share(
    rows: DataFrame, keys: Sequence[str], value: str, share: float, flag: str, min_rows: int = 1, bins: int = BINS
) -> DataFrame:
    """``rows`` with ``flag``: whether the value is beyond the group's top ``share``; false in groups of fewer than ``min_rows``.

    A null value has a null flag in a group that is large enough. ``rows`` is read three times: pass a stored table.
    """
    limits = store(cut_offs(rows, keys, value, 1.0 - share, bins).withColumnsRenamed({"n": "__n", "cut_off": "__cut"}), "cuts")
    enough = F.coalesce(F.col("__n"), F.lit(0)) >= min_rows
    return attach(rows, limits, keys).withColumn(flag, enough & (F.col(value) > F.col("__cut"))).drop("__n", "__cut")
