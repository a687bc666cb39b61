import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from frames import weekly
from weekwatch.operators import iforest

G = ["department"]
M = ["cases_total", "hosp_total"]


def two_metrics(spark, n, group="A", seed=0):
    rng = np.random.default_rng(seed)
    values = [float(v) for v in rng.normal(100, 10, n)]
    return weekly(spark, values, group).withColumn(
        "hosp_total", F.col("cases_total") * 0.3 + F.crc32(F.col("week_start").cast("string")) / 1e9
    )


def test_expected_path():
    assert list(iforest.expected_path([0, 1, 2])) == [0.0, 0.0, 1.0]
    assert iforest.expected_path(256) == pytest.approx(10.2448, abs=1e-3)


def grow_by_hand(rows, chance, node, depth, limit, out):
    """The same tree, one node at a time."""
    low, high = rows.min(axis=0), rows.max(axis=0)
    usable = [i for i in range(rows.shape[1]) if high[i] > low[i]]
    if depth == limit or not usable:
        out[node] = len(rows)
        return
    f = usable[int(chance[node, 0] * len(usable))]
    cut = low[f] + chance[node, 1] * (high[f] - low[f])
    left = rows[:, f] <= cut
    grow_by_hand(rows[left], chance, 2 * node + 1, depth + 1, limit, out)
    grow_by_hand(rows[~left], chance, 2 * node + 2, depth + 1, limit, out)


def test_trees_grown_together_equal_trees_grown_alone():
    rows = np.random.default_rng(1).poisson(5, (5, 256, 3)).astype(float)
    generators = [np.random.default_rng([7, t]) for t in range(5)]
    grown = iforest._grow(rows.reshape(-1, 3), [256] * 5, generators)
    for t in range(5):
        rng = np.random.default_rng([7, t])
        drawn = rows[t]
        chance, leaves = rng.random((511, 2)), {}
        grow_by_hand(drawn, chance, 0, 0, 8, leaves)
        feature, _, size = (part[t] for part in grown)
        mine = {i: size[i] for i in range(511) if size[i] and feature[i] < 0}
        assert mine == leaves


def test_path_length_is_leaf_depth_plus_what_the_leaf_stands_for():
    feature = np.array([0, -1, -1], dtype=np.int32)
    threshold, size = np.array([1.5, 0, 0]), np.array([6, 5, 1])
    lengths = iforest._path_lengths(np.array([[1.0], [2.0]]), feature, threshold, size)
    assert lengths == pytest.approx([1 + iforest.expected_path(5), 1.0])


def test_planted_rows_rank_first(spark):
    series = two_metrics(spark, 400)
    odd = F.dayofyear("week_start") == 3
    planted = series.withColumn("cases_total", F.when(odd, F.lit(900.0)).otherwise(F.col("cases_total")))
    n = planted.filter(odd).count()
    assert n
    scored = iforest.flag_isolation_forest(planted, G, M)
    top = scored.orderBy(F.desc("iforest_score")).limit(n).collect()
    assert {r["cases_total"] for r in top} == {900.0}
    assert all(0 < r["iforest_score"] < 1 for r in scored.collect())


@pytest.mark.parametrize("n", [30, 150, 1197])
def test_one_percent_is_flagged(spark, n):
    flagged = iforest.flag_isolation_forest(two_metrics(spark, n), G, M)
    assert flagged.filter("is_iforest").count() == int(0.01 * (n - 1)) + 1


def test_small_groups_are_left_alone(spark):
    series = two_metrics(spark, 29).unionByName(two_metrics(spark, 40, group=None))
    rows = iforest.flag_isolation_forest(series, G, M).collect()
    assert len(rows) == 69
    assert {(r["iforest_score"], r["is_iforest"]) for r in rows if r["department"]} == {(0.0, False)}
    assert sum(r["is_iforest"] for r in rows if r["department"] is None) == 1


def test_partitioning_does_not_change_the_forest(spark):
    series = two_metrics(spark, 200).unionByName(two_metrics(spark, 80, "B", 3))
    expected = spark_rows(iforest.flag_isolation_forest(series, G, M))
    for n in (1, 7, 64):
        assert spark_rows(iforest.flag_isolation_forest(series.repartition(n), G, M)) == expected


def test_slices_do_not_change_the_scores(spark, monkeypatch):
    series = two_metrics(spark, 200)
    expected = spark_rows(iforest.flag_isolation_forest(series, G, M))
    monkeypatch.setattr(iforest, "ROWS_PER_SLICE", 30)
    assert spark_rows(iforest.flag_isolation_forest(series, G, M)) == expected


def test_missing_and_whole_number_metrics_survive(spark):
    large = 2**60 + 1
    series = weekly(spark, [None, large, *range(50)]).withColumn("hosp_total", F.lit(None).cast("bigint"))
    scored = iforest.flag_isolation_forest(series, G, M)
    assert scored.schema["cases_total"] == series.schema["cases_total"]
    assert {r["cases_total"] for r in scored.collect()} == {None, large, *range(50)}


def test_every_tree_draws_its_own_rows(spark):
    forest = iforest.iforest_fit(two_metrics(spark, 300), G, M, n_trees=4, max_samples=16).collect()
    assert [sorted(t["__tree"] for t in forest), {t["__samples"] for t in forest}] == [[0, 1, 2, 3], {16}]
    assert all(t["size"][0] == 16 for t in forest)
    assert len({tuple(t["threshold"]) for t in forest}) == 4


def test_trees_of_a_long_group_draw_from_all_of_it(spark):
    # Longer than all trees together can look at: no part of the series is left out.
    n = 60_000
    rows = spark.range(n).selectExpr("'A' as department", "date_add(date'1900-01-01', cast(id as int)) as week_start",
                                     "cast(id as double) as cases_total")
    forest = iforest.iforest_fit(rows, G, ["cases_total"]).collect()
    assert len(forest) == 200 and {t["__samples"] for t in forest} == {256}
    roots = np.array([t["threshold"][0] for t in forest])
    # A first cut is uniform between the extremes of 256 rows of the whole series.
    assert np.histogram(roots, bins=4, range=(0, n))[0].min() >= 25
    inner = np.array([c for t in forest for c, f in zip(t["threshold"], t["feature"]) if f >= 0])
    assert np.histogram(inner, bins=10, range=(0, n))[0].min() >= 1200


def test_few_rows_are_all_drawn(spark):
    forest = iforest.iforest_fit(two_metrics(spark, 40), G, M, n_trees=30).collect()
    assert {t["__samples"] for t in forest} == {40} and len(forest) == 30
