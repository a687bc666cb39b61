"""Targets and takings of the mix."""

from collections import defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weekwatch.llm.mixing import mix, mixed_rows, source_targets

SCHEMA = "doc_id long, text string, source string, size int, target string"


def by_hand(sizes):
    """Share by weight, again and again, until no target is above twice its source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, target, stopped = Fraction(3, 2) * sum(sizes.values()), {}, set()
    while True:
        left = budget - sum(2 * sizes[s] for s in stopped)
        open_ = [s for s in order if s not in stopped]
        weights = sum(weight[s] for s in open_)
        target = {s: left * weight[s] / weights for s in open_} | {s: Fraction(2 * sizes[s]) for s in stopped}
        above = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not above:
            return target
        stopped |= above


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.sampled_from([None, "", "A", "a", "b", "é", "z", "😀"]), st.integers(0, 1000), min_size=1))
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(rows).collect()}
    assert got == pytest.approx({s: float(t) for s, t in by_hand(sizes).items()})


def docs_of(spark):
    rows = [(i, "w " * (1 + i * 7919 % 60), f"s{i % 3}" if i % 4 else "hot", 0, "x") for i in range(1500)]
    rows += [(None, "null id", None, 0, None), (1, None, "s1", 0, None), (2, "", "s2", 0, None), (3, "\n ", "s0", 0, None)]
    rows += [(4000, "long " * 20_000, "big", 0, None), (4001, "short one", "big", 0, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_takings_come_near_the_targets(spark):
    docs = docs_of(spark)
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    taken, largest, targets = defaultdict(int), defaultdict(int), {}
    sizes = defaultdict(int)
    for r in rows:
        assert r["taken"] == r["times"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        targets[r["source"]] = r["target"]
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)
    assert targets == pytest.approx({s: float(t) for s, t in by_hand(sizes).items()})
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1e-6
    again = mix(docs_of(spark).repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_rows_are_repeated_whole(spark):
    docs = docs_of(spark)
    times = defaultdict(int)
    for r in mix(docs).collect():
        times[r["doc_id"], r["size"]] += r["times"]
    got = mixed_rows(docs)
    assert got.columns == docs.columns
    count = defaultdict(int)
    for r in got.collect():
        count[r["doc_id"], len((r["text"] or "").split())] += 1
    assert count == {k: v for k, v in times.items() if v}


def test_no_rows_and_no_words(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mix(none).collect() == [] and mixed_rows(none).collect() == []
    empty = spark.createDataFrame([(1, None, "a", 0, None), (2, "", None, 0, None)], SCHEMA)
    assert {(r["size"], r["target"], r["taken"]) for r in mix(empty).collect()} == {(0, 0.0, 0)}
