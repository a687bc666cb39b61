"""Found neighbours against brute force."""

import math

import numpy as np

from weekwatch.llm import neighbours
from weekwatch.llm.neighbours import chi_square_limit, nearest, region_of, top_cuts

SCHEMA = "vec_id long, embedding array<float>, q string, region string"


def brute(rows, every, k):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    ids = sorted(good)
    all_ = np.array(ids)
    matrix = np.stack([good[i] for i in ids])
    out = {}
    for q in ids:
        if q % every == 0:
            d = np.sqrt(((matrix - good[q]) ** 2).sum(axis=1))
            out[q] = [(int(all_[j]), float(d[j])) for j in np.lexsort((all_, d)) if all_[j] != q][:k]
    return out


def found(spark, rows, every, k):
    vectors = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in nearest(vectors, vectors.where(f"vec_id % {every} = 0"), k).orderBy("query_id", "rank").collect():
        lines = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(lines) + 1
        lines.append((r["vec_id"], r["score"]))
    return out


def recall(got, expected):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in expected.items())
    return hits / sum(len(near) for near in expected.values())


def check_scores(rows, got):
    good = {r[0]: np.array(r[1], np.float32).astype(float) for r in rows if r[1]}
    for q, lines in got.items():
        assert lines == sorted(lines, key=lambda x: (x[1], x[0]))
        for i, score in lines:
            assert i != q
            assert abs(score - np.linalg.norm(good[i] - good[q])) < 1e-9


def test_recall_on_the_given_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 256)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 8)
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], None, None) for r in given.collect()]
    got, expected = found(spark, rows, 100, 10), brute(rows, 100, 10)
    assert set(got) == set(expected)
    assert all(len(v) == 10 for v in got.values())
    check_scores(rows, got)
    assert recall(got, expected) >= 0.9


def test_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist(), "a", None) for i in range(1, 120)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "b", None) for i in range(1000, 1200)]  # a large group of copies
    rows += [rows[9], rows[9], rows[150]]
    rows += [(2000, None, None, None), (2010, [0.0] * 6, None, None), (2020, [math.nan] * 6, None, None),
             (2030, [1.0, None, 1.0, 1.0, 1.0, 1.0], None, None), (2040, [math.inf] * 6, None, None), (2050, [], None, None),
             (None, [1.0] * 6, None, None), (2060, [1.0, 2.0], None, None)]
    got = found(spark, rows, 10, 5)
    expected = brute([r for r in rows if r[0] != 2060], 10, 5)
    assert set(got) == set(expected)
    assert recall(got, expected) >= 0.9
    for q in range(1000, 1200, 10):
        assert [i for i, _ in got[q]] == [i for i in range(1000, 1010) if i != q][:5]
        assert {s for _, s in got[q]} == {0.0}


def test_few_and_no_rows(spark):
    assert found(spark, [(0, [1.0, 0.0], None, None), (1, [0.0, 1.0], None, None)], 1, 10) == {
        0: [(1, math.sqrt(2))], 1: [(0, math.sqrt(2))]
    }
    assert found(spark, [(0, [1.0], None, None)], 1, 10) == {}
    assert found(spark, [], 1, 10) == {}


def test_the_stopping_limit():
    # Quantiles of the chi-square law.
    assert abs(chi_square_limit(8, 0.95) - 15.507) < 1e-3
    assert abs(chi_square_limit(2, 0.5) - 1.386) < 1e-3


def test_regions_split_at_medians():
    points = np.random.default_rng(1).normal(size=(1024, 4))
    counts = np.bincount(region_of(points, top_cuts(points, 3)), minlength=8)
    assert counts.sum() == 1024 and counts.min() >= 120


def check_whole(rows, every, k, got):
    """Each query has ``k`` answers, or all there are, with verified distances."""
    expected = brute(rows, every, k)
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in expected.items() if v}
    check_scores(rows, got)
    return expected


def test_every_query_has_all_its_rows_on_the_given_vectors(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], None, None) for r in given.collect()]
    got = found(spark, rows, 10, 10)
    assert recall(got, check_whole(rows, 10, 10, got)) >= 0.9


def test_every_query_has_all_its_rows_in_near_copies_and_groups(spark):
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(60):  # clusters of near copies: the bound is tight, and the home block holds the cluster
        center = rng.normal(size=32)
        rows += [(len(rows) + j, (center + rng.normal(scale=1e-3, size=32)).tolist(), None, None) for j in range(12)]
    rows += [(10_000 + i, [0.1] * 32, None, None) for i in range(1, 300)]  # copies, and a lone query beside them
    rows += [(10_000, [0.1] * 31 + [0.100001], None, None)]
    got = found(spark, rows, 10, 10)
    assert recall(got, check_whole(rows, 10, 10, got)) >= 0.9
    assert [i for i, _ in got[10_000]] == list(range(10_001, 10_011))


def test_projections_of_equal_vectors_are_within_rounding():
    rng = np.random.default_rng(2)
    matrix = neighbours.directions(384)
    vectors = rng.normal(size=(500, 384)) * 10.0 ** rng.integers(-6, 7, size=(500, 1))
    alone = np.stack([v @ matrix for v in vectors])
    apart = ((vectors @ matrix - alone) ** 2).sum(axis=1)
    assert apart.max() > 0
    assert (apart <= neighbours.reach(0.0, chi_square_limit(8, 0.98), neighbours.rounding(vectors, matrix))).all()


def test_the_length_is_that_of_the_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist(), None, None) for i in range(1, 101)]
    short = [(i, rng.normal(size=2).tolist(), None, None) for i in range(200, 400, 10)]  # most of the queries
    got, expected = found(spark, rows + short, 10, 5), brute(rows, 10, 5)
    assert set(got) == set(expected) == set(range(10, 101, 10))
    assert all(len(v) == 5 for v in got.values())
    check_scores(rows, got)
