"""Exact vector search, top-k and its merges.

A batch of queries is scored against blocks of vectors with one matrix product per Arrow batch, and
each task keeps its own best k of every query, so k rows a query and task are exchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import METRICS
from ..sources.scratch import stash

MAX_K = 100_000
#: Bytes of query vectors that one job broadcasts; a larger batch is searched in parts.
MAX_QUERY_BYTES = 16 << 20
#: Bytes of distances that a task computes at once.
TILE_BYTES = 64 << 20


def resolve_k(k: int | None = None, limit: int | None = None) -> int:
    """k from k and a LIMIT: 10 unless given, the smaller of both, 0 if below 1, at most 100,000."""
    k = 10 if k is None else k
    if limit is not None:
        k = min(k, limit)
    return 0 if k < 1 else min(k, MAX_K)


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """List column to a float64 matrix; lists of another length raise."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column):
        return np.zeros((0, dim or 0))
    dim = dim or len(flat) // len(column)
    if len(flat) != dim * len(column):
        raise ValueError(f"vectors must have {dim} elements")
    return flat.reshape(len(column), dim)


def collect_queries(queries: DataFrame, id_col: str, vec_col: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query ids and vectors in parts of at most ``MAX_QUERY_BYTES``, one at a time."""
    ids: list[int] = []
    vectors: list[list[float]] = []
    size = 0
    for r in queries.select(id_col, vec_col).toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        size += 8 * len(r[1])
        if size >= MAX_QUERY_BYTES:
            yield np.array(ids, np.int64), np.array(vectors, np.float64)
            ids, vectors, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, np.float64)


def in_parts(queries: DataFrame, id_col: str, vec_col: str, search: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """What ``search`` gives for the queries, which it gets broadcast in parts of bounded size.

    One part stays a plan. Of several, each result is written before the next part is fetched, so
    neither the driver nor the executors hold two parts.
    """
    spark = queries.sparkSession
    parts = collect_queries(queries, id_col, vec_col)
    first = next(parts, (np.zeros(0, np.int64), np.zeros((0, 1))))
    following = next(parts, None)
    shared = spark.sparkContext.broadcast(first)
    if following is None:
        return search(shared)
    out = None
    while shared is not None:
        done = stash(search(shared), "part")
        shared.destroy()
        out = done if out is None else out.unionByName(done)
        shared, following = (spark.sparkContext.broadcast(following), next(parts, None)) if following is not None else (None, None)
    return out


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.maximum((q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1)[None], 0)
    return 1 - q @ x.T


def exact_search(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", limit: int | None = None, include_self: bool = True, digits: int = 6) -> DataFrame:
    """(qid, rank, id, distance): the k nearest of each query, ties to the smaller id.

    Distances are rounded before they are ranked, so the order doesn't depend on how sums are
    grouped.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    k = resolve_k(k, limit)
    source = base.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    schema = "qid long, id long, distance double"
    if not k:
        return base.sparkSession.createDataFrame([], "qid long, rank int, id long, distance double")

    def search(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            best_d = np.full((len(qids), 0), np.inf)
            best_i = np.zeros((len(qids), 0), np.int64)
            step = max(1, TILE_BYTES // (8 * max(1, len(qids))))
            for batch in batches if len(qids) else ():
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    own = part.column(0).to_numpy(zero_copy_only=False)
                    d = np.round(distances(q, matrix(part.column(1), q.shape[1]), metric), digits) + 0.0
                    if not include_self:
                        d[qids[:, None] == own[None]] = np.inf
                    d = np.hstack([best_d, d])
                    i = np.hstack([best_i, np.broadcast_to(own, (len(qids), len(own)))])
                    order = np.lexsort((i, d), axis=1)[:, :k]
                    best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            row, column = np.nonzero(np.isfinite(best_d))
            yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(best_i[row, column]), pa.array(best_d[row, column])], ["qid", "id", "distance"])

        return top_k(source.mapInArrow(run, schema), k, [F.col("distance"), F.col("id")]).select("qid", "rank", "id", "distance")

    return in_parts(queries, id_col, vec_col, search)


def top_k(scored: DataFrame, k: int, by: list[Column]) -> DataFrame:
    """First k rows of each qid; partial lists are cut before the exchange (WindowGroupLimit)."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*by))).where(F.col("rank") <= k)


def merge_top_k(parts: list[DataFrame], k: int) -> DataFrame:
    """The best k of lists (qid, id, distance) from several indexes."""
    both = parts[0].select("qid", "id", "distance")
    for part in parts[1:]:
        both = both.unionByName(part.select("qid", "id", "distance"))
    return top_k(both, k, [F.col("distance"), F.col("id")]).select("qid", "rank", "id", "distance")
