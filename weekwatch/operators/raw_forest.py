"""The isolation forest on raw rows: groups of any length, however unequal.

Trees are those of ``operators.iforest``. Where the forest is small enough to be sent to every task, rows are
scored where they lie and are not shuffled; beyond that they meet slices of it. The cut-off comes from
histograms that add up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekwatch.functions.cutoffs import flag_top_share
from weekwatch.functions.ordered import BROADCAST_GROUPS, attach
from weekwatch.operators import iforest
from weekwatch.sources.scratch import store

#: Bytes of trees that each task may hold; a node takes 16, a tree of 256 rows 8 KB.
BROADCAST_BYTES = 64 * 2**20
_NODE_BYTES = 16
#: Rows that a task scores at once.
ROWS_AT_ONCE = 2**17


def _fits(forest: DataFrame, most: int) -> bool:
    nodes, trees = forest.agg(F.sum(F.size("size")), F.count(F.lit(1))).first()
    return (nodes or 0) * _NODE_BYTES <= most and trees <= BROADCAST_GROUPS


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """The batches in tables of ``least`` rows or somewhat more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= least:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def score(
    rows: DataFrame,
    forest: DataFrame,
    group_keys: Sequence[str],
    metrics: Sequence[str],
    row_id: str,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``iforest.iforest_score`` of rows in any number; both ways give the same scores to the last bit.

    The forest is sent to the tasks where it takes at most ``broadcast_bytes``, which is looked at first;
    it grows with the number of groups, never with the rows. ``forest`` is read several times: pass a stored one.
    """
    keys = list(group_keys)
    if not _fits(forest, broadcast_bytes):
        return iforest.iforest_score(rows, forest, keys, metrics, row_id, counted=True)
    spark = rows.sparkSession
    numbers = [row.asDict() for row in forest.select(*keys).distinct().collect()]
    group_schema = T.StructType([*(forest.schema[k] for k in keys), T.StructField("__forest", T.IntegerType())])
    groups = spark.createDataFrame([(*(row[k] for k in keys), i) for i, row in enumerate(numbers)], group_schema)
    trees = attach(forest, groups, keys, len(numbers)).select("__forest", "__tree", "__samples", *iforest._NODE_ARRAYS)
    grown = {}
    table = trees.toArrow().sort_by([("__forest", "ascending"), ("__tree", "ascending")])
    for number in range(len(numbers)):
        mine = table.filter(pa.compute.equal(table.column("__forest"), number))
        nodes = [iforest._vectors(mine, name) for name in iforest._NODE_ARRAYS]
        grown[number] = (nodes, mine.column("__samples")[0].as_py())
    sent = spark.sparkContext.broadcast(grown)
    ready = attach(rows, groups, keys, len(numbers)).withColumn("__x", iforest._features(metrics))

    def score_batches(batches):
        forests = sent.value
        tables, met = {}, dict.fromkeys(forests, 0)
        for part in _gathered(batches, ROWS_AT_ONCE):
            scores = np.zeros(len(part))
            own = part.column("__forest").fill_null(-1).to_numpy()
            values = iforest._vectors(part, "__x") if len(part) else None
            for number in np.unique(own[own >= 0]).tolist():
                nodes, samples = forests[number]
                here = own == number
                met[number] += here.sum()
                if number not in tables and met[number] >= iforest.TABLE_ROWS:
                    tables[number] = iforest._tables(nodes, values.shape[1])
                depth = iforest._total_lengths(values[here], nodes, tables.get(number))
                scores[here] = 2.0 ** (-depth / (len(nodes[0]) * float(iforest.expected_path(samples))))
            out = part.drop_columns(["__forest", "__x"]).append_column("iforest_score", pa.array(scores, pa.float64()))
            yield from out.to_batches()

    schema = T.StructType([*rows.schema.fields, T.StructField("iforest_score", T.DoubleType())])
    return ready.mapInArrow(score_batches, schema)


def flag_isolation_forest(
    rows: DataFrame,
    group_keys: Sequence[str],
    metrics: Sequence[str],
    row_id: str,
    contamination: float = iforest.CONTAMINATION,
    min_rows: int = iforest.MIN_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    **settings,
) -> DataFrame:
    """Fit, score and flag raw rows that ``row_id`` tells apart: the columns of ``iforest.flag_isolation_forest``.

    ``row_id`` makes the draws of a tree; rows that share it and all metrics would be drawn together. The rows are
    read several times: pass a stored table.
    """
    forest = iforest.iforest_fit(rows, group_keys, metrics, row_id, min_rows=min_rows, counted=True, **settings)
    forest = store(forest, "forest")
    scored = store(score(rows, forest, group_keys, metrics, row_id, broadcast_bytes), "scores")
    return flag_top_share(scored, group_keys, "iforest_score", contamination, "is_iforest", min_rows)
