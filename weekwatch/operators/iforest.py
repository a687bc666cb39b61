"""Isolation forest (Liu, Ting and Zhou, 2008) as a Spark job, one forest per group.

Spark draws the rows of each tree, spreads the trees over tasks, brings trees and
rows together, and finds the threshold. Python sees the drawn rows of one block of
trees and a bounded slice of rows per scoring call, never a whole table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekwatch.functions.ordered import attach

# The usual settings of the method.
N_TREES = 200
MAX_SAMPLES = 256
CONTAMINATION = 0.01
MIN_ROWS = 30
SEED = 42

TREES_PER_BLOCK = 25
ROWS_PER_SLICE = 262_144
#: Trees are made into tables of at most so many cells, for groups of at least so many rows.
TABLE_CELLS = 2**16
TABLE_ROWS = 2**16

_NODE_ARRAYS = {"feature": pa.int32(), "threshold": pa.float64(), "size": pa.int32()}
_TREE_FIELDS = [
    T.StructField("__slices", T.LongType()),
    T.StructField("__samples", T.IntegerType()),
    T.StructField("__tree", T.IntegerType()),
    T.StructField("feature", T.ArrayType(T.IntegerType())),
    T.StructField("threshold", T.ArrayType(T.DoubleType())),
    T.StructField("size", T.ArrayType(T.IntegerType())),
]


def expected_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    inner = np.maximum(n, 3.0)
    mean = 2.0 * (np.log(inner - 1.0) + np.euler_gamma) - 2.0 * (inner - 1.0) / inner
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, mean))


def _grow(rows: np.ndarray, counts: Sequence[int], generators: Sequence[np.random.Generator]):
    """One tree per generator, all grown together, one level at a time.

    ``rows`` holds the rows drawn by the first tree, then by the second, and so on; ``counts``
    says how many each has. Returns ``feature`` (-1 in a leaf), ``threshold`` and ``size`` with
    one row per tree, the nodes in heap order: the children of i are 2i+1 and 2i+2.
    """
    depth = int(np.ceil(np.log2(max(*counts, 2))))
    slots = 2 ** (depth + 1) - 1
    chance = np.stack([g.random((slots, 2)) for g in generators]).reshape(-1, 2)
    root = np.repeat(np.arange(len(generators)) * slots, counts)
    node = root.copy()
    feature = np.full(len(chance), -1, dtype=np.int32)
    threshold = np.zeros(len(chance))
    size = np.bincount(node, minlength=len(chance))
    for _ in range(depth):
        order = np.argsort(node, kind="stable")
        here, start = np.unique(node[order], return_index=True)
        low = np.minimum.reduceat(rows[order], start, axis=0)
        high = np.maximum.reduceat(rows[order], start, axis=0)
        usable = (high > low).cumsum(axis=1)
        number = np.floor(chance[here, 0] * usable[:, -1])
        column = (usable > number[:, None]).argmax(axis=1)
        at = np.arange(len(here))
        low, high = low[at, column], high[at, column]
        cut = low + chance[here, 1] * (high - low)
        splits = usable[:, -1] > 0
        feature[here[splits]] = column[splits]
        threshold[here[splits]] = np.where(cut < high, cut, low)[splits]
        going = feature[node] >= 0
        rows, node, root = rows[going], node[going], root[going]
        right = rows[np.arange(len(rows)), feature[node]] > threshold[node]
        node = root + 2 * (node - root) + 1 + right
        size += np.bincount(node, minlength=len(size))
        if not len(node):
            break
    shape = (len(generators), slots)
    return feature.reshape(shape), threshold.reshape(shape), size.reshape(shape)


def _lengths(size: np.ndarray) -> np.ndarray:
    """For each node the depth that it stands for as a leaf: its own, and that of its rows below it."""
    return np.floor(np.log2(np.arange(1, len(size) + 1))) + expected_path(size)


def _path_lengths(rows: np.ndarray, feature, threshold, size) -> np.ndarray:
    """Depth of the leaf each row falls into, plus the depth the leaf stands for."""
    inner, length = feature >= 0, _lengths(size)
    feature, threshold = np.where(inner, feature, 0).astype(np.int64), np.where(inner, threshold, np.inf)
    flat = np.ascontiguousarray(rows).reshape(-1)
    first = np.arange(len(rows)) * rows.shape[1]
    place = np.zeros(len(rows), dtype=np.int64)
    for level in range(int(np.log2(len(feature) + 1)) - 1):
        here, below = slice(2**level - 1, 2 ** (level + 1) - 1), slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1)
        # No value is beyond the threshold of a leaf: rows go left from it, and find its length there.
        left = length[below][::2]
        left[:] = np.where(inner[here], left, length[here])
        value = flat.take(first + feature[here].take(place))
        place += place
        place += value > threshold[here].take(place >> 1)
    return length[len(feature) // 2 :].take(place)


class Cells:
    """A tree as a table: where a value lies among the thresholds of its column, for each column, names the length."""

    def __init__(self, feature, threshold, size, columns: int):
        own = [feature == c for c in range(columns)]
        self.cuts = [np.unique(threshold[x]) for x in own]
        shape = [len(c) + 1 for c in self.cuts]
        self.steps = [math.prod(shape[c + 1 :]) for c in range(columns)]
        rank = np.zeros(len(threshold))
        for x, cuts in zip(own, self.cuts):
            rank[x] = np.searchsorted(cuts, threshold[x])
        cells = np.indices(shape).reshape(columns, -1).T
        self.lengths, code = np.unique(_path_lengths(cells, feature, rank, size), return_inverse=True)
        self.code = code.reshape(-1).astype(np.uint8 if len(self.lengths) <= 256 else np.uint32)

    @staticmethod
    def fit(feature, columns: int) -> bool:
        """Whether the trees' tables, at most, are small."""
        cuts = np.stack([(feature == c).sum(axis=1) + 1.0 for c in range(columns)])
        return bool((cuts.prod(axis=0) <= TABLE_CELLS).all())


def _tables(nodes: Sequence[np.ndarray], columns: int) -> list[Cells] | None:
    """The trees as tables, where these are small: with few columns."""
    return [Cells(*tree, columns) for tree in zip(*nodes)] if Cells.fit(nodes[0], columns) else None


def _total_lengths(rows: np.ndarray, nodes: Sequence[np.ndarray], tables: list[Cells] | None = None) -> np.ndarray:
    """The sum over all trees of each row's path; the same to the last bit with and without tables."""
    total = np.zeros(len(rows))
    if tables is None:
        for tree in zip(*nodes):
            total += _path_lengths(rows, *tree)
        return total
    rows = np.where(np.isnan(rows), -np.inf, rows)  # neither is beyond any threshold
    order = np.argsort(rows[:, 0])
    rows = rows[order]
    orders = [np.argsort(column) for column in rows.T]
    ordered = [column[o] for column, o in zip(rows.T, orders)]
    back = [np.argsort(o) for o in orders]
    for tree in tables:
        cell = np.zeros(len(rows), dtype=np.int64)
        for number, (column, cuts, step) in enumerate(zip(ordered, tree.cuts, tree.steps)):
            # In the order of a column, the rows between two thresholds follow one another.
            ends = np.concatenate([[0], np.searchsorted(column, cuts, side="right"), [len(column)]])
            part = np.repeat(np.arange(len(cuts) + 1) * step, np.diff(ends))
            cell += part if number == 0 else part.take(back[number])
        total += tree.lengths.take(tree.code.take(cell))
    out = np.empty(len(rows))
    out[order] = total
    return out


def _vectors(table: pa.Table, name: str) -> np.ndarray:
    """An array column as a matrix with one row per row of the table."""
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), -1)


def _features(metrics: Sequence[str]) -> Column:
    """The metrics as one vector, missing values as zero."""
    return F.array(*(F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in metrics))


def _chance(date_col: str, metrics: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(date_col), *(F.col(m) for m in metrics))


def _with_size(rows: DataFrame, keys: Sequence[str], counted: bool = False) -> DataFrame:
    """Attach ``__rows``, the size of the row's group; null keys are a group.

    Over a window, or ``counted`` before the shuffle, where no task may hold a whole group.
    """
    if counted:
        return attach(rows, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")), keys)
    return rows.withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def _reach(samples: int) -> float:
    """So many rows of a group are expected below a hash that at least ``samples`` are there."""
    return samples + 10.0 * samples**0.5 + 40.0


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by the keys into the session's number of shuffle partitions.

    The rows are few and small but costly to work on, so the partitions must not
    be merged by their size in bytes, which adaptive execution would do.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _slices() -> Column:
    return F.ceil(F.col("__rows") / F.lit(ROWS_PER_SLICE)).cast("bigint")


def iforest_fit(
    series: DataFrame,
    group_keys: Sequence[str],
    metrics: Sequence[str],
    date_col: str = "week_start",
    n_trees: int = N_TREES,
    max_samples: int = MAX_SAMPLES,
    seed: int = SEED,
    min_rows: int = MIN_ROWS,
    counted: bool = False,
) -> DataFrame:
    """The trees: one row per group and tree, for groups with at least ``min_rows`` rows.

    Every tree draws its own ``max_samples`` rows from all rows of its group, or takes them
    all if there are fewer: those with the smallest hash of seed, tree and row. Each row
    finds out by itself which trees may draw it, and is sent once to each block of them: a
    tree's hashes below ``_reach`` hold enough rows but for a chance of about 1e-20. So neither
    partitioning nor retries change the forest, and a long group sends few rows to each tree.

    A group's size is a window over the group: pass a series, one row per group and date, as
    ``weekly_series`` makes it. Its groups are as long as the calendar. With ``counted`` groups may
    be of any length; rows that share date and metrics are drawn together, so raw rows need an own
    id as ``date_col``.
    """
    keys = list(group_keys)
    sized = _with_size(series.select(*keys, date_col, *metrics), keys, counted).filter(F.col("__rows") >= min_rows)
    hashed = lambda tree: F.xxhash64(F.lit(seed), tree, F.col(date_col), *(F.col(m) for m in metrics))
    first, last = F.col("__block") * TREES_PER_BLOCK, (F.col("__block") + 1) * TREES_PER_BLOCK - 1
    chances = F.transform(
        F.sequence(first, F.least(last, F.lit(n_trees - 1))),
        lambda tree: F.struct(tree.alias("tree"), hashed(tree).alias("chance")),
    )
    may_draw = lambda chance: (chance / F.lit(2.0**64) + 0.5) * F.col("__rows") <= _reach(max_samples)
    drawing = F.filter(chances, lambda draw: may_draw(draw["chance"]))
    # Rows of a long group are drawn by hardly any tree: they are asked for each tree, in generated code, and sent to
    # the tree. Others are sent once to each block of trees, which is a number below zero here, with their draws.
    blocks = F.sequence(F.lit(-((n_trees - 1) // TREES_PER_BLOCK) - 1), F.lit(-1))
    is_long = F.col("__rows") > TREES_PER_BLOCK * _reach(max_samples)
    item, chance = F.col("__item"), hashed(F.col("__item"))
    drawn = (
        sized.withColumn("__item", F.explode(F.when(is_long, F.sequence(F.lit(0), F.lit(n_trees - 1))).otherwise(blocks)))
        .filter((item < 0) | may_draw(chance))
        .withColumn("__block", F.when(item < 0, -1 - item).otherwise(F.floor(item / TREES_PER_BLOCK)).cast("int"))
        .withColumn("__draws", F.when(item < 0, drawing).otherwise(F.array(F.struct(item.alias("tree"), chance.alias("chance")))))
        .select(
            *keys,
            "__block",
            date_col,
            _features(metrics).alias("__x"),
            F.xxhash64(*keys).alias("__seed"),
            _slices().alias("__slices"),
            F.col("__draws.tree").alias("__trees"),
            F.col("__draws.chance").alias("__chances"),
        )
    )
    work = _spread(drawn, *keys, "__block")
    schema = T.StructType([series.schema[c] for c in keys] + _TREE_FIELDS)

    def grow_block(table: pa.Table) -> pa.Table:
        table = table.sort_by(date_col)
        lists = [table.column(name).combine_chunks() for name in ("__trees", "__chances")]
        trees, chances = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        row = np.repeat(np.arange(len(table)), lists[0].value_lengths().to_numpy(zero_copy_only=False))
        order = np.lexsort((row, chances, trees))
        trees, row = trees[order], row[order]
        place = np.arange(len(trees)) - np.searchsorted(trees, trees)
        trees, row = trees[place < max_samples], row[place < max_samples]
        numbers, counts = np.unique(trees, return_counts=True)
        stream = table.column("__seed")[0].as_py() & (2**64 - 1)
        seeds = [np.random.default_rng([seed, stream, int(number)]) for number in numbers]
        grown = _grow(_vectors(table, "__x")[row], counts, seeds)
        out = table.select([*keys, "__slices"]).take(pa.array(np.zeros(len(numbers), dtype=np.int64)))
        out = out.append_column("__samples", pa.array(counts, pa.int32()))
        out = out.append_column("__tree", pa.array(numbers, pa.int32()))
        for (name, kind), nodes in zip(_NODE_ARRAYS.items(), grown):
            out = out.append_column(name, pa.array(list(nodes), pa.list_(kind)))
        return out

    return work.groupBy(*keys, "__block").applyInArrow(grow_block, schema)


def iforest_score(
    series: DataFrame,
    forest: DataFrame,
    group_keys: Sequence[str],
    metrics: Sequence[str],
    date_col: str = "week_start",
    counted: bool = False,
) -> DataFrame:
    """The series with ``iforest_score``: near 1 is easy to isolate, 0.0 without a forest.

    Rows meet the trees of their group. A long group is cut into slices by a hash
    of the row, and its trees are sent to each slice, so no task gets a whole group.
    """
    keys = list(group_keys)
    slice_of_row = F.pmod(_chance(date_col, metrics, 0), _slices())
    rows = _with_size(series, keys, counted).select(
        *series.columns, slice_of_row.alias("__slice"), _features(metrics).alias("__x")
    )
    every_slice = F.sequence(F.lit(0).cast("bigint"), F.col("__slices") - 1)
    trees = forest.withColumn("__slice", F.explode(every_slice))

    def score_slice(table: pa.Table, grown: pa.Table) -> pa.Table:
        scores = np.zeros(len(table))
        if len(table) and len(grown):
            grown = grown.sort_by("__tree")
            values = _vectors(table, "__x")
            nodes = [_vectors(grown, name) for name in _NODE_ARRAYS]
            tables = _tables(nodes, values.shape[1]) if len(values) >= TABLE_ROWS else None
            scores = _total_lengths(values, nodes, tables)
            usual = float(expected_path(grown.column("__samples")[0].as_py()))
            scores = 2.0 ** (-scores / (len(grown) * usual))
        return table.drop_columns(["__slice", "__x"]).append_column(
            "iforest_score", pa.array(scores, pa.float64())
        )

    schema = T.StructType([*series.schema.fields, T.StructField("iforest_score", T.DoubleType())])
    return (
        _spread(rows, *keys, "__slice")
        .groupBy(*keys, "__slice")
        .cogroup(_spread(trees, *keys, "__slice").groupBy(*keys, "__slice"))
        .applyInArrow(score_slice, schema)
    )


def flag_iforest(
    scored: DataFrame,
    group_keys: Sequence[str],
    contamination: float = CONTAMINATION,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """``is_iforest``: scores beyond the group's top ``contamination`` share."""
    group = Window.partitionBy(*group_keys)
    limit = F.percentile("iforest_score", 1.0 - contamination).over(group)
    enough = F.count(F.lit(1)).over(group) >= min_rows
    return scored.withColumn("is_iforest", enough & (F.col("iforest_score") > limit))


def flag_isolation_forest(
    series: DataFrame,
    group_keys: Sequence[str],
    metrics: Sequence[str],
    date_col: str = "week_start",
    **settings,
) -> DataFrame:
    """Fit, score and flag. The series is read several times: pass a stored one."""
    contamination = settings.pop("contamination", CONTAMINATION)
    forest = iforest_fit(series, group_keys, metrics, date_col, **settings)
    scored = iforest_score(series, forest, group_keys, metrics, date_col)
    return flag_iforest(
        scored, group_keys, contamination, settings.get("min_rows", MIN_ROWS)
    )
