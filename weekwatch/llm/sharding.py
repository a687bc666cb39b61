"""Shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. The shards
take turns, each claiming the first free slot of its order, until the table is full. A key's hash
picks a slot; the slot names the shard. When a shard leaves, few keys of the others move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.llm.text import unit_hash

# Slots per shard, about; shares of shards differ by one slot at most.
SLOTS_PER_SHARD = 100
# A table with more slots is refused: it is sent to every task.
MAX_SLOTS = 2_000_000
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def table_size(shards: int, per_shard: int = SLOTS_PER_SHARD) -> int:
    """The smallest prime that gives each shard ``per_shard`` slots."""
    size = max(3, shards * per_shard)
    while any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        size += 1
    return size


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], size: int | None = None) -> list[int]:
    """The index of the shard that owns each slot.

    The claims follow one another, so they are made here, over names and slots only; the number of
    steps depends on the table's size and not on the data. Shard names must differ.
    """
    size = size or table_size(len(shards))
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need different names, and at least one")
    if size > MAX_SLOTS or size < len(shards):
        raise ValueError(f"{size} slots for {len(shards)} shards; at most {MAX_SLOTS} slots")
    slot = [_hash(f"offset:{s}") % size for s in shards]
    skip = [_hash(f"skip:{s}") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while owner[slot[i]] >= 0:
            slot[i] = (slot[i] + skip[i]) % size
        owner[slot[i]] = i
    return owner


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key; a null key is the empty text."""
    return unit_hash(key) % size


def assign(
    df: DataFrame, key: str, shards: Sequence[str] = SHARDS, size: int | None = None
) -> DataFrame:
    """``key, slot, shard`` of every row; null keys go to the shard of the empty text.

    The table is a small frame, one row per slot, that is broadcast; its size has a fixed bound.
    Equal keys share a shard, whatever the other columns; rows are never moved here.
    """
    owner = lookup_table(shards, size)
    spark = df.sparkSession
    owners = F.array(*(F.lit(s) for s in shards))
    slots = F.lit(",".join(map(str, owner)))
    lookup = spark.range(1).select(F.posexplode(F.split(slots, ",")).alias("slot", "owner"))
    lookup = lookup.select(
        F.col("slot").cast("bigint").alias("slot"),
        F.element_at(owners, F.col("owner").cast("int") + 1).alias("shard"),
    )
    rows = df.select(F.col(key).alias("key"), slot_of(F.col(key), len(owner)).alias("slot"))
    return rows.join(F.broadcast(lookup), "slot").select("key", "slot", "shard")


def write_shards(df: DataFrame, key: str, path: str, shards: Sequence[str] = SHARDS, files: int = 8) -> None:
    """Write whole rows to one folder per shard, each in up to ``files`` parts.

    Rows are dealt by slot and part of the key's hash, so that a large shard is not one task.
    """
    owner = lookup_table(shards)
    names = F.array(*(F.lit(shards[i]) for i in owner))
    slot = slot_of(F.col(key), len(owner))
    placed = df.withColumn("shard", F.element_at(names, slot.cast("int") + 1))
    part = F.pmod(F.xxhash64(key), F.lit(files))
    placed.repartition(F.col("shard"), part).write.partitionBy("shard").parquet(path)
