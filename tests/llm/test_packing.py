"""Best-fit packing against one piece at a time."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weekwatch.llm.packing import LENGTHS, _cheapest, pack, plan_bins


def one_by_one(histogram, lengths):
    """Each piece by itself, longest first, into the bin it leaves least room in."""
    bins = []  # [room, pieces]
    for length, n in sorted(histogram, reverse=True):
        for _ in range(n):
            fits = [b for b in bins if b[0] >= length]
            if fits:
                best = min(fits, key=lambda b: b[0])
            else:
                best = [_cheapest(length, lengths), []]
                bins.append(best)
            best[0] -= length
            best[1].append(length)
    return Counter((tuple(p), min(c for c in lengths if c >= sum(p))) for _, p in bins)


def from_plan(histogram, lengths):
    plan, bins = plan_bins(histogram, lengths)
    held = {}
    seen = Counter()
    for length, first, n, bin_, each, filled in plan:
        for i in range(n):
            b = held.setdefault(bin_ + i // each, [])
            assert sum(b) == filled + (i % each) * length
            b.append(length)
        seen[length] += n
    assert seen == Counter({length: n for length, n in histogram if n})
    sizes = {b: c for first, many, c in bins for b in range(first, first + many)}
    assert set(sizes) == set(held)
    return Counter((tuple(p), sizes[b]) for b, p in held.items())


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 30), max_size=12))
def test_plan_is_the_packing_of_single_pieces(counts):
    histogram = list(counts.items())
    assert from_plan(histogram, (4, 8, 16)) == one_by_one(histogram, (4, 8, 16))


def check(spark, rows, lengths):
    texts = spark.createDataFrame(rows, "doc_id long, text string, bin string, LENGTH string")
    got = pack(texts.drop("LENGTH"), lengths).collect()
    bins = {}
    for r in got:
        bins.setdefault((r["bin"], r["bin_length"]), []).append((r["bin_start"], r["length"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), parts in bins.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= size and not [c for c in lengths if at <= c < size]
    words = Counter()
    for r in got:
        words[r["doc_id"]] += r["length"]
    expected = Counter()
    for doc_id, text, *_ in rows:
        expected[doc_id] += len((text or "").split())
    assert words == Counter({k: v for k, v in expected.items() if v})
    histogram = Counter(r["length"] for r in got)
    packed = Counter((tuple(sorted((n for _, n in p), reverse=True)), size) for (_, size), p in bins.items())
    assert packed == one_by_one(list(histogram.items()), lengths)


def test_pack_edges(spark):
    rows = [(i, "w " * (i % 23), None, "x") for i in range(300)]
    rows += [(None, "a b", "z", None), (5, "a b", None, None), (5, "a b", None, None), (7, None, None, None)]
    rows += [(1000, "w " * 999, None, None), (1001, " \n ", None, None)]
    check(spark, rows, (4, 8, 16))


def test_one_length_may_be_most_rows(spark, monkeypatch):
    monkeypatch.setattr("weekwatch.llm.packing.NUMBERED", 50)
    check(spark, [(i, "a b c", None, None) for i in range(700)], (4, 8, 16))


def test_no_rows_and_wrong_lengths(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pack(none, LENGTHS).collect() == []
    with pytest.raises(ValueError, match="lengths"):
        pack(none, [0])
