"""Running totals and ranks within groups that no task has to hold whole.

Rows are dealt out by ranges of group and order, so a long group lies in many tasks. Totals run inside
each range; what lies before a range in the same group is a sum over a few rows per group, one per range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekwatch.sources.scratch import store

#: Groups that are joined to raw rows by a broadcast; beyond so many, rows are spread over salted copies of them.
BROADCAST_GROUPS = 200_000
SALTS = 16


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equal columns, null equal to null."""
    every = F.lit(True)
    for a, b in zip(left, right, strict=True):
        every = every & F.col(a).eqNullSafe(F.col(b))
    return every


def attach(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], groups: int | None = None) -> DataFrame:
    """Every row with the values of its group, however unequal the groups are; null keys meet null keys.

    ``per_group`` is counted, unless ``groups`` says how many rows it has.
    """
    names = {k: f"__group_{i}" for i, k in enumerate(keys)}
    renamed = per_group.withColumnsRenamed(names)
    count = per_group.count() if groups is None else groups
    if count <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(renamed), same(keys, list(names.values())), "left").drop(*names.values())
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = renamed.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = same(keys, list(names.values())) & (F.col("__salt") == F.col("__copy"))
    return salted.join(copies.hint("merge"), on, "left").drop(*names.values(), "__salt", "__copy")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Add ``__upto``, the total of ``weight`` (1) in the group up to the row, and ``__total``, that of the group.

    Null is first in the order, and rows that are equal in it follow one another as they come.
    """
    weighed = df.withColumn("__weight", (F.lit(1) if weight is None else weight).cast("bigint"))
    dealt = store(weighed.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sizes = dealt.groupBy("__range", *keys).agg(F.sum("__weight").alias("__size"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumns(
        {"__before": F.coalesce(F.sum("__size").over(before), F.lit(0)), "__total": F.sum("__size").over(group)}
    ).drop("__size")
    counted = dealt.withColumn("__upto", F.sum("__weight").over(inside))
    found = attach(counted, offsets, ["__range", *keys])
    return found.withColumn("__upto", F.col("__upto") + F.col("__before")).drop("__before", "__range", "__weight")


def value_counts(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``keys, metric, value, n``: how often a group has a value; nulls are not counted."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    long = df.select(*keys, pairs.alias("__pair")).select(*keys, "__pair.metric", "__pair.value")
    return long.where(F.col("value").isNotNull()).groupBy(*keys, "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def rank_quantiles(
    counts: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float], mode: str = "nearest"
) -> DataFrame:
    """``keys`` and a column per quantile, from ``value`` and ``n`` of each group.

    ``nearest`` is the value at the rank ``(n - 1) * q``, halves up; ``linear`` goes between the two ranks.
    """
    if mode not in ("nearest", "linear"):
        raise ValueError(f"mode must be nearest or linear, not {mode!r}")
    ranked = running(counts, keys, ["value"], F.col("n"))
    found, values = [], {}
    for name, q in quantiles.items():
        place = (F.col("__total") - 1) * F.lit(float(q))
        low, high = (F.floor(place + 0.5),) * 2 if mode == "nearest" else (F.floor(place), F.ceil(place))
        for side, rank in (("low", low), ("high", high)):
            # The row whose values take up that rank.
            here = (F.col("__upto") > rank) & (F.col("__upto") - F.col("n") <= rank)
            found.append(F.max(F.when(here, F.col("value"))).alias(f"__{name}_{side}"))
        found.append(F.max(place - F.floor(place)).alias(f"__{name}_part"))
        a, b, part = (F.col(f"__{name}_{x}") for x in ("low", "high", "part"))
        values[name] = F.when(a == b, a).otherwise((1 - part) * a + part * b)
    return ranked.groupBy(*keys).agg(*found).select(*keys, *(v.alias(name) for name, v in values.items()))
