"""The lookup table, and what moves when a shard leaves."""

from collections import Counter

import pytest

from weekwatch.llm.sharding import MAX_SLOTS, SHARDS, assign, lookup_table, table_size, write_shards


def test_slots_are_shared_evenly():
    owner = lookup_table(SHARDS)
    assert len(owner) == table_size(64) == 6421
    counts = Counter(owner).values()
    assert max(counts) - min(counts) <= 1 and len(counts) == 64


def test_few_slots_move_when_a_shard_leaves():
    before = [SHARDS[i] for i in lookup_table(SHARDS)]
    rest = SHARDS[:20] + SHARDS[21:]
    after = [rest[i] for i in lookup_table(rest, len(before))]
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != SHARDS[20])
    assert SHARDS[20] not in after and moved < 0.15 * len(before)


def test_refused():
    for shards, size in ((["a", "a"], None), ([], None), (["a"], MAX_SLOTS + 1), (["a", "b", "c", "d"], 3)):
        with pytest.raises(ValueError, match="s"):
            lookup_table(shards, size)


def test_assign(spark, tmp_path):
    rows = [(i % 400, "s", None) for i in range(800)] + [(None, "x", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, shard string, slot int")
    got = assign(docs, "doc_id", SHARDS[:4]).collect()
    assert len(got) == 803
    where = {}
    for r in got:
        assert where.setdefault(r["key"], r["shard"]) == r["shard"]
    assert set(where.values()) == set(SHARDS[:4])
    assert assign(docs.limit(0), "doc_id").collect() == []
    write_shards(docs.drop("shard"), "doc_id", f"{tmp_path}/out", SHARDS[:4], files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == set(where.items()) and back.count() == 803
