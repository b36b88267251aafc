"""Offline retrieval quality: each item's nearest others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: vectors that a task holds of the query side at a time
BLOCK = 4096


def _best(scores: np.ndarray, own: np.ndarray, others: np.ndarray, k: int) -> list[tuple]:
    """(own, other, score) of the k greatest of each row, ties to the smaller other."""
    out: list[tuple] = []
    if not scores.size:
        return out
    # the k greatest, with all that tie with the last of them
    place = max(0, scores.shape[1] - k)
    least = np.partition(scores, place, axis=1)[:, place]
    for i, mine in enumerate(own):
        some = np.flatnonzero(scores[i] >= least[i])
        order = some[np.lexsort((others[some], -scores[i, some]))][:k]
        out += [(int(mine), int(others[j]), float(scores[i, j])) for j in order if scores[i, j] > -np.inf]
    return out


def nearest_others(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", blocks: int | None = None) -> DataFrame:
    """(query, key, score, rank) of the k nearest others of every row, ties to the smaller key.

    Rows are dealt into blocks, and a task gets an unordered pair of blocks: one
    product of at most BLOCK^2 scores, read by rows for the one block and by columns for the other.
    So each pair of rows is multiplied once, a row goes to one task a block, and k candidates a row leave each.
    """
    n = vectors.count()
    blocks = blocks or max(1, -(-n // BLOCK))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    paired = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    paired = paired.select(F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "id", "v")

    def multiply(pair: tuple, table: pa.Table) -> pa.Table:
        x, y = (p.as_py() for p in pair)
        ids, block = table["id"].to_numpy(), table["b"].to_numpy()
        matrix = np.asarray(table["v"].combine_chunks().flatten()).reshape(len(ids), -1)
        left, right = block == x, block == y
        scores = np.round(matrix[left] @ matrix[right].T, 9)
        if x == y:
            scores[ids[left][:, None] == ids[right]] = -np.inf
        out = _best(scores, ids[left], ids[right], k)
        if x != y:
            out += _best(scores.T, ids[right], ids[left], k)
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"query": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    best = paired.groupBy("x", "y").applyInArrow(multiply, "query long, id long, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def retrieval_quality(nearest: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """precision_at_1 and recall_at_k over all queries, for truth (id, family): a hit is an item of the same family."""
    mine = truth.select(F.col("id").alias("query"), F.col("family").alias("own"))
    rows = nearest.join(mine, "query").join(truth, "id").withColumn("hit", (F.col("own") == F.col("family")).cast("int"))
    by_query = rows.groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("hit"))).alias("first"), (F.sum("hit") / k).alias("recall"))
    return by_query.agg(F.avg("first").alias("precision_at_1"), F.avg("recall").alias("recall_at_k"), F.count(F.lit(1)).alias("queries"))
