"""The forest and its cut-off on raw rows, against the window forms and plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from weekwatch.functions import cutoffs, ordered
from weekwatch.operators import iforest, raw_forest
from weekwatch.sources.scratch import store

M = ["a", "b"]


def by_group(rows):
    out = {}
    for key, value in rows:
        if value is not None:
            out.setdefault(key, []).append(value)
    return out


@pytest.mark.parametrize("groups", [200_000, 0])
@pytest.mark.parametrize(("quantile", "bins"), [(0.99, 4096), (0.5, 3), (0.99, 1), (0.0, 7), (1.0, 7)])
def test_cut_offs(spark, monkeypatch, quantile, bins, groups):
    monkeypatch.setattr(ordered, "BROADCAST_GROUPS", groups)
    pick = random.Random(3)
    rows = [("hot", pick.gauss(0, 1)) for _ in range(700)] + [("steps", float(pick.randrange(4))) for _ in range(90)]
    rows += [(None, pick.random()) for _ in range(101)] + [("flat", 2.0)] * 50 + [("one", -1.5), ("two", 1.0), ("two", 3.0)]
    rows += [("nulls", None), ("hot", None), ("ends", 1e300), ("ends", 0.0), *[("ends", 1e-9 * i) for i in range(30)]]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r["g"]: (r["n"], r["cut_off"]) for r in cutoffs.cut_offs(df, ["g"], "x", quantile, bins).collect()}
    exact = df.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", quantile).alias("p")).where("n > 0").collect()
    assert got == {r["g"]: (r["n"], r["p"]) for r in exact}
    assert got.keys() == by_group(rows).keys()
    for key, values in by_group(rows).items():
        assert got[key][1] == pytest.approx(np.quantile(values, quantile))


def test_cut_offs_of_nothing(spark):
    assert cutoffs.cut_offs(spark.createDataFrame([], "g string, x double"), ["g"], "x", 0.5).collect() == []


def test_flags_of_few_rows_and_nulls(spark):
    rows = [("a", float(i)) for i in range(100)] + [("b", float(i)) for i in range(5)] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = cutoffs.flag_top_share(df, ["g"], "x", 0.05, "top", min_rows=6).collect()
    assert sorted(r["x"] for r in got if r["top"]) == [95.0, 96.0, 97.0, 98.0, 99.0]
    assert len(got) == len(rows) and {r["top"] for r in got if r["g"] == "b"} == {False}
    assert {(r["g"], r["top"]) for r in got if r["x"] is None} == {("a", None), ("c", False)}


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", i, float(rng.normal()), i % 7) for i in range(3000)] + [("small", i, 1.0 * i, None) for i in range(29)]
    rows += [(None, i, float(rng.poisson(3)), i % 3) for i in range(400)]
    rows[11] = ("hot", 11, 90.0, 500)
    return store(spark.createDataFrame(rows, "g string, id long, a double, b long").repartition(5), "lines")


def test_sent_forest_and_sliced_forest_score_alike(lines):
    forest = store(iforest.iforest_fit(lines, ["g"], M, "id", n_trees=40), "forest")
    sent = raw_forest.score(lines, forest, ["g"], M, "id")
    sliced = raw_forest.score(lines, forest, ["g"], M, "id", broadcast_bytes=0)
    assert "MapInArrow" in sent._jdf.queryExecution().toString() and "CoGroup" in sliced._jdf.queryExecution().toString()
    assert spark_rows(sent) == spark_rows(sliced)
    assert sent.schema == sliced.schema
    alone = {r["iforest_score"] for r in sent.where("g = 'small'").collect()}
    assert alone == {0.0}


def test_no_row_is_shuffled_to_be_scored(lines):
    forest = store(iforest.iforest_fit(lines, ["g"], M, "id", n_trees=5), "forest")
    plan = raw_forest.score(lines, forest, ["g"], M, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange range" not in plan


def test_same_flags_as_the_window_form(lines):
    ours = raw_forest.flag_isolation_forest(lines, ["g"], M, "id", n_trees=40)
    theirs = iforest.flag_isolation_forest(lines, ["g"], M, "id", n_trees=40)
    assert spark_rows(ours) == spark_rows(theirs)
    flagged = ours.where("is_iforest").collect()
    assert ("hot", 11) in {(r["g"], r["id"]) for r in flagged}
    # Thirty rows lie beyond the cut-off, fewer where scores are equal.
    assert 20 <= sum(r["g"] == "hot" for r in flagged) <= 30


@pytest.mark.parametrize("columns", [1, 2, 6])
def test_trees_as_tables_score_alike(columns):
    rng = np.random.default_rng(8)
    drawn = np.concatenate([rng.integers(0, 40, (256 * 9, 1)), rng.normal(size=(256 * 9, 5))], axis=1)[:, :columns]
    nodes = iforest._grow(drawn, [256] * 9, [np.random.default_rng([1, i]) for i in range(9)])
    rows = np.concatenate([drawn[:700], rng.normal(size=(900, columns)) * 20, np.zeros((3, columns))])
    rows[:3, 0], rows[3] = [np.nan, np.inf, -np.inf], rows[4]
    plain = iforest._total_lengths(rows, nodes)
    node = np.zeros(len(rows), int)  # the last tree once more, row by row
    for at, row in enumerate(rows):
        while nodes[0][-1][node[at]] >= 0:
            node[at] = 2 * node[at] + 1 + (row[nodes[0][-1][node[at]]] > nodes[1][-1][node[at]])
    last = np.floor(np.log2(node + 1)) + iforest.expected_path(nodes[2][-1][node])
    assert (last == iforest._path_lengths(rows, *(x[-1] for x in nodes))).all()
    tables = iforest._tables(nodes, columns)
    assert (tables is None) == (columns == 6)
    if tables:
        assert (iforest._total_lengths(rows, nodes, tables) == plain).all()


def test_tables_where_many_rows_are_scored(lines, monkeypatch):
    forest = store(iforest.iforest_fit(lines, ["g"], M, "id", n_trees=9), "forest")
    plain = spark_rows(raw_forest.score(lines, forest, ["g"], M, "id"))
    monkeypatch.setattr(iforest, "TABLE_ROWS", 100)
    monkeypatch.setattr(raw_forest, "ROWS_AT_ONCE", 150)
    for sent in (raw_forest.BROADCAST_BYTES, 0):
        assert spark_rows(raw_forest.score(lines, forest, ["g"], M, "id", broadcast_bytes=sent)) == plain


def test_long_groups_are_asked_tree_by_tree(spark, monkeypatch):
    """In generated code, and for the same forest as when they are asked block by block."""
    rows = spark.range(14_000).select(F.when(F.col("id") < 1500, "short").otherwise("long").alias("g"), "id", F.xxhash64("id").alias("a"))
    fit = lambda: iforest.iforest_fit(rows, ["g"], ["a"], "id", n_trees=30, counted=True)
    found = fit()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "transform" not in plan.split("Generate")[-1].split("Scan")[0].split("BroadcastExchange")[0]
    by_tree = sorted(map(str, found.collect()))
    assert len(by_tree) == 60
    monkeypatch.setattr(iforest, "_reach", lambda samples: 1000.0)
    assert sorted(map(str, fit().collect())) == by_tree


def test_empty_table(lines):
    assert raw_forest.flag_isolation_forest(lines.limit(0), ["g"], M, "id", n_trees=2).collect() == []


def test_sizes_take_no_window_over_a_group(lines):
    plan = iforest._with_size(lines, ["g"], counted=True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_count" in plan
