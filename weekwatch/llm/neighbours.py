"""Nearest neighbours by stable projections, a kd-tree and a chi-square test.

Vectors are projected to a few dimensions by random directions, and cut into blocks by the top of a
kd-tree of the projections. In a block, a kd-tree gives the neighbours of a query in order of their
projected distance; each is verified on the whole vectors. The squared projected distance of a
point, over its squared distance, follows a chi-square law; so the search stops at a projected
distance that a point nearer than the k-th found would exceed with a small probability only. The
test decides where to look; what was found and verified before stays an answer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekwatch.sources.scratch import store

# Projected dimensions (even), the seed of the directions, and how sure the stopping test is.
DIMENSIONS, SEED, SURE = 8, 17, 0.98
# About so many vectors make a block, so many queries a batch, so many points a leaf of a block's tree.
BLOCK_ROWS, QUERY_ROWS, LEAF_ROWS = 4096, 2048, 64
# The cuts between blocks are fitted to at most so many vectors: those with the smallest hashes.
SAMPLE_ROWS = 5_000
# A region of the top of the tree holds at least so many vectors of the sample.
REGION_SAMPLE = 25


def chi_square_limit(dimensions: int, sure: float) -> float:
    """The value that a chi-square variable of even degree exceeds with probability ``1 - sure``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        above = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))
        low, high = (x, high) if above > 1 - sure else (low, x)
    return high


def directions(length: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Independent normal directions, the stable law of the Euclidean distance."""
    return np.random.default_rng(seed).normal(size=(length, dimensions))


def rounding(queries: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """How far the projections of each query and of a vector equal to it may lie apart as computed."""
    size = np.sqrt((queries**2).sum(axis=-1)) * np.sqrt((matrix**2).sum())
    return 4 * len(matrix) * np.finfo(float).eps * size


def reach(bound: float | np.ndarray, limit: float, slack: float | np.ndarray) -> float | np.ndarray:
    """The squared projected distance up to which a point within ``bound`` is looked for."""
    return (math.sqrt(limit) * bound * (1 + 1e-9) + slack) ** 2


# ---- trees --------------------------------------------------------------------------------------


def top_cuts(points: np.ndarray, depth: int) -> np.ndarray:
    """Cuts of a kd-tree as rows ``(dimension, value)`` in heap order: medians of the widest side."""
    cuts = np.zeros(((1 << depth) - 1, 2))

    def cut(node: int, rows: np.ndarray) -> None:
        if node >= len(cuts):
            return
        side = int(np.argmax(np.ptp(rows, axis=0))) if len(rows) else 0
        value = float(np.median(rows[:, side])) if len(rows) else 0.0
        cuts[node] = side, value
        left = rows[:, side] <= value
        cut(2 * node + 1, rows[left])
        cut(2 * node + 2, rows[~left])

    cut(0, points)
    return cuts


def region_of(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The leaf of the cuts that each point falls into, from 0."""
    node = np.zeros(len(points), np.int64)
    for _ in range((len(cuts) + 1).bit_length() - 1):
        side, value = cuts[node, 0].astype(int), cuts[node, 1]
        node = 2 * node + 1 + (points[np.arange(len(points)), side] > value)
    return node - len(cuts)


def tree_order(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The leaves of a kd-tree over the rows, each with at most ``LEAF_ROWS`` of them."""
    if len(rows) <= LEAF_ROWS:
        return [rows]
    side = int(np.argmax(np.ptp(points[rows], axis=0)))
    half = len(rows) // 2
    split = rows[np.argpartition(points[rows, side], half)]
    return tree_order(points, split[:half]) + tree_order(points, split[half:])


class Block:
    """Vectors with their ids, ordered by a kd-tree of their projections."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], matrix: np.ndarray):
        leaves = tree_order(projected := vectors @ matrix, np.arange(len(vectors)))
        order = np.concatenate(leaves)
        self.vectors, self.projected = vectors[order], projected[order]
        self.ids, self.matrix = [ids[i] for i in order], matrix
        self.ends = np.cumsum([len(leaf) for leaf in leaves])
        self.starts = self.ends - [len(leaf) for leaf in leaves]
        self.low = np.minimum.reduceat(self.projected, self.starts)
        self.high = np.maximum.reduceat(self.projected, self.starts)

    def nearest(self, query: np.ndarray, place: np.ndarray, k: int, bound: float, limit: float) -> list[tuple[float, int]]:
        """The ``k`` nearest by distance and id, among those the stopping test lets through.

        ``bound`` is a distance within which ``k`` neighbours are known already.
        """
        gap = np.maximum(0.0, np.maximum(self.low - place, place - self.high))
        far = (gap**2).sum(axis=1)
        slack = rounding(query, self.matrix)
        found: list[tuple[float, int]] = []
        for leaf in np.argsort(far, kind="stable"):
            most = reach(bound, limit, slack)
            if far[leaf] > most:
                break
            rows = slice(self.starts[leaf], self.ends[leaf])
            near = np.flatnonzero(((self.projected[rows] - place) ** 2).sum(axis=1) <= most)
            near += self.starts[leaf]
            distance = np.sqrt(((self.vectors[near] - query) ** 2).sum(axis=1))
            real = distance <= bound
            if real.any():
                for d, row in zip(distance[real].tolist(), near[real].tolist(), strict=True):
                    found.extend((d, i) for i in self.ids[row])
                found = sorted(found)[:k]
                if len(found) == k:
                    bound = min(bound, found[-1][0])
        return found


# ---- the operator -------------------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` in double precision, of the rows that take part.

    Vectors that are null, empty or zero, or hold a null or a value that is not finite, take no
    part; neither do rows without an id.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(
        F.col("vec_id").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    )


def usual_length(rows: DataFrame) -> int:
    """The most frequent length of the vectors, the smallest of equally frequent ones; 0 without rows."""
    found = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 0


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sure: float = SURE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors found for each query.

    ``queries`` has the same columns as ``vectors``; a row with the query's own id is no answer.
    The score is the Euclidean distance of the whole vectors; equal ones go by id. Rows repeated
    with the same id and vector count once. With fewer candidates than ``k`` all come out. Vectors
    and queries of another length than the most frequent one of the vectors take no part.

    Equal vectors are one point with its ``k + 1`` smallest ids, as no other of them can be an
    answer; so are equal queries. A point is compared with batches of queries in its block.
    """
    rows = usable(vectors, id_col, vector_col)
    length = usual_length(rows)
    rows = rows.where(F.size("vector") == length)
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    points = (
        rows.withColumn("at", F.dense_rank().over(smallest))
        .where(F.col("at") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    )
    points = store(points, "points")
    asked = usable(queries, id_col, vector_col).where(F.size("vector") == length).distinct()
    distinct = store(asked.select("vector").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")

    sample = points.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE_ROWS).toPandas()["vector"]
    matrix = directions(max(1, length))
    n, n_queries = points.count(), distinct.count()
    depth = max(0, math.ceil(math.log2(max(1, min(n / BLOCK_ROWS, len(sample) / REGION_SAMPLE)))))
    cuts = top_cuts(np.stack(sample.to_list()) @ matrix if len(sample) else np.zeros((0, DIMENSIONS)), depth)
    batches = max(1, -(-n_queries // QUERY_ROWS))

    @F.pandas_udf("int")
    def region(vector: pd.Series) -> pd.Series:
        if not len(vector):
            return pd.Series([], dtype="int32")
        return pd.Series(region_of(np.stack(vector.to_list()) @ matrix, cuts)).astype("int32")

    placed = points.withColumn("region", region("vector"))
    counts = placed.groupBy("region").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = store(
        placed.join(counts, "region").withColumn("block", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int")),
        "placed",
    )
    lined = distinct.withColumn("region", region("vector")).withColumn(
        "batch", F.pmod(F.xxhash64("q"), F.lit(batches)).cast("int")
    )
    home = lined.select("region", F.lit(0).alias("block"), "batch", "q", "vector", F.lit(float("inf")).alias("bound"))
    first = store(_search(placed.where("block = 0"), home, k + 1, matrix, sure, batches), "first")
    bounds = first.groupBy("q").agg(
        F.when(F.count("*") == k + 1, F.max("score")).otherwise(float("inf")).alias("bound")
    )
    # One row per region, of which the sample allows a fixed number.
    boxes = _boxes(placed, matrix)
    known = lined.join(bounds, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    everywhere = _routed(known, boxes, matrix, sure)
    # A point is in one block and the home block is not searched again, so no answer comes twice.
    answers = first.unionByName(_search(placed, everywhere, k + 1, matrix, sure, batches))
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    answers = answers.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at")

    names = asked.join(distinct, "vector").select(F.col("vec_id").alias("query_id"), "q")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (
        names.join(answers, "q")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _boxes(placed: DataFrame, matrix: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """Per region the corners of its projected points, and its number of blocks."""

    def corners(batches):
        for batch in batches:
            if len(batch):
                points = np.stack(batch["vector"].to_list()) @ matrix
                for r, at in batch.groupby("region").indices.items():
                    low, high = points[at].min(axis=0), points[at].max(axis=0)
                    yield pd.DataFrame({"region": [r], "blocks": [batch["blocks"].iloc[at[0]]], "low": [low], "high": [high]})

    found = placed.select("region", "blocks", "vector").mapInPandas(
        corners, "region int, blocks int, low array<double>, high array<double>"
    )
    whole = found.groupBy("region", "blocks").agg(
        *(F.min(F.col("low")[i]).alias(f"low{i}") for i in range(matrix.shape[1])),
        *(F.max(F.col("high")[i]).alias(f"high{i}") for i in range(matrix.shape[1])),
    )
    take = lambda r, side: np.array([r[f"{side}{i}"] for i in range(matrix.shape[1])])
    return {r["region"]: (take(r, "low"), take(r, "high"), r["blocks"]) for r in whole.collect()}


def _routed(known: DataFrame, boxes: dict, matrix: np.ndarray, sure: float) -> DataFrame:
    """A row for each query and block that may hold a nearer point, by the stopping test.

    The home block, where the bound comes from, is left out: its answers are known.
    """
    limit = chi_square_limit(matrix.shape[1], sure)

    def route(batches):
        for batch in batches:
            if not len(batch):
                continue
            wanted, home = np.stack(batch["vector"].to_list()), batch["region"].to_numpy()
            places, most = wanted @ matrix, reach(batch["bound"].to_numpy(), limit, rounding(wanted, matrix))
            for r, (low, high, blocks) in boxes.items():
                far = (np.maximum(0.0, np.maximum(low - places, places - high)) ** 2).sum(axis=1)
                for block in range(blocks):
                    going = batch[(far <= most) & ((home != r) | (block > 0))]
                    yield going.assign(region=r, block=block)[["region", "block", "batch", "q", "vector", "bound"]]

    return known.select("region", "batch", "q", "vector", "bound").mapInPandas(
        route, "region int, block int, batch int, q bigint, vector array<double>, bound double"
    )


def _search(points: DataFrame, asked: DataFrame, k: int, matrix: np.ndarray, sure: float, batches: int) -> DataFrame:
    """Search each block for each batch of queries that comes to it."""
    limit = chi_square_limit(matrix.shape[1], sure)

    def search(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(queries):
            block = Block(np.stack(points["vector"].to_list()), points["ids"].to_list(), matrix)
            wanted = np.stack(queries["vector"].to_list())
            for q, query, place, bound in zip(queries["q"], wanted, wanted @ matrix, queries["bound"], strict=True):
                out += [(q, d, i) for d, i in block.nearest(query, place, k, bound, limit)]
        return pd.DataFrame(out, columns=["q", "score", "vec_id"])

    copies = points.select(
        "region", "block", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), "vector", "ids"
    )
    keys = ["region", "block", "batch"]
    return copies.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        search, "q bigint, score double, vec_id bigint"
    )
