"""Counting quotient filters and exact groups."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weekwatch.llm import exact_dedup
from weekwatch.llm.exact_dedup import build_filter, drop_copies, exact_groups, merge_filters, read_filter

PRINTS = st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40), min_size=1, max_size=200)


def filter_of(prints):
    return build_filter(*np.unique(np.array(prints, np.uint64), return_counts=True))


@settings(max_examples=100, deadline=None)
@given(PRINTS)
def test_a_filter_loses_nothing(prints):
    found, counts = read_filter(filter_of(prints))
    expected, many = np.unique(np.array(prints, np.uint64), return_counts=True)
    assert found.tolist() == expected.tolist() and counts.tolist() == many.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(PRINTS, min_size=1, max_size=5))
def test_merged_filters_hold_all_counts(lists):
    found, counts = merge_filters([filter_of(x) for x in lists])
    expected, many = np.unique(np.array(sum(lists, []), np.uint64), return_counts=True)
    assert found.tolist() == expected.tolist() and counts.tolist() == many.tolist()


ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a b "), (None, "a b"), (7, None), (8, ""), (2, "   "), (1, " "),
    (4, "x" * 300_000), (6, "x" * 300_000), (10, "é"), (11, "É"), (12, "a b"), (3, "a b"), (3, "a\tb"), (None, "z"),
]


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    out = []
    for (doc_id, _), text in zip(rows, norm, strict=True):
        ids = [i for (i, _), t in zip(rows, norm, strict=True) if t == text]
        known = [i for i in ids if i is not None]
        out.append((doc_id, min(known) if known else None, len(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("buffered", [1_000_000, 2])
def test_groups(spark, monkeypatch, buffered):
    monkeypatch.setattr(exact_dedup, "BUFFERED", buffered)
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in ROWS], "doc_id long, text string, size int, sha string")
    rows = exact_groups(docs.repartition(3)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows), key=str) == brute(ROWS)
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_equal_fingerprints_are_compared_byte_by_byte(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: exact_dedup.F.lit(7).cast("bigint"))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows = exact_groups(docs).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows), key=str) == brute(ROWS)


def test_rows_that_stay_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in ROWS], "doc_id long, text string, id string")
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in ROWS})
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 4, 7, 9, 10, 11, 12]


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(none).collect() == [] and drop_copies(none).collect() == []
