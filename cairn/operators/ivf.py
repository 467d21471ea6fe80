"""Inverted lists: coarse centroids, assignment, residual codes and search."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import METRICS
from ..sources.scratch import stash
from .dense import distances, in_parts, matrix, top_k
from .lexical import hint
from .quantize import Codebook, kmeans, sample


#: Lists that a filter names one by one.
MAX_NAMED_LISTS = 1000
#: Bytes of the distances that are computed at once.
BLOCK_BYTES = 32 << 20
#: Rows that k-means runs on at the driver; a larger sample stays in its table.
DRIVER_ROWS = 65_536
#: Queries that are compared with all vectors to learn how far codes mislead.
MARGIN_QUERIES = 64


def list_count(n: int, given: int = 0) -> int:
    """Lists for n vectors: 4 sqrt(n) unless given, n at most."""
    return max(1, min(n, given or int(4 * np.sqrt(n))))


def nearest(centroids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The list of each vector: the smallest squared distance, the lowest number on ties."""
    out = np.empty(len(x), np.int64)
    size = (centroids**2).sum(1)
    step = max(1, BLOCK_BYTES // (8 * max(1, len(centroids))))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = size[None] - 2 * part @ centroids.T
        least = d.min(1)
        out[at : at + step] = d.argmin(1)
        # what the product can't tell apart is told by plain differences
        close = d <= (least + 1e-9 * (1 + (part**2).sum(1)))[:, None]
        for n in np.flatnonzero(close.sum(1) > 1):
            own = np.flatnonzero(close[n])
            out[at + n] = own[((part[n] - centroids[own]) ** 2).sum(1).argmin()]
    return out


def assign(df: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, list_id)."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = nearest(shared.value, matrix(batch.column(1), shared.value.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64())], ["id", "list_id"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, "id long, list_id long").withColumnRenamed("id", id_col)


def residuals(df: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vector less the centroid of its list), which a codebook of residuals is trained on."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), shared.value.shape[1])
            rest = x - shared.value[nearest(shared.value, x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(rest.ravel()))], [id_col, vec_col])

    return df.select(F.col(id_col).cast("long").alias(id_col), vec_col).mapInArrow(run, f"`{id_col}` long, `{vec_col}` array<double>")


def lloyd(df: DataFrame, start: np.ndarray, iterations: int, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """Lloyd steps over all rows; each task sends sums of k x dim, an empty list keeps its centroid."""
    c = start.astype(np.float64)
    for _ in range(iterations):
        shared = df.sparkSession.sparkContext.broadcast(c)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            sums, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                x = matrix(batch.column(0), c.shape[1])
                own = nearest(c, x)
                np.add.at(sums, own, x)
                n += np.bincount(own, minlength=len(c))
            full = np.flatnonzero(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * c.shape[1]), pa.array(sums[full].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), lists], ["list_id", "n", "sums"])

        parts = df.select(F.col(vec_col).alias("v")).mapInArrow(run, "list_id long, n long, sums array<double>")
        spread = parts.select("list_id", "n", F.posexplode("sums").alias("d", "x")).groupBy("list_id", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        c = c.copy()
        lists = spread.groupBy("list_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("d", "x"))).alias("s"))
        got = lists.select("list_id", "n", F.transform("s", lambda p: p["x"]).alias("s")).toArrow()  # a row a list
        if got.num_rows:
            c[got["list_id"].to_numpy()] = matrix(got["s"].combine_chunks(), c.shape[1]) / got["n"].to_numpy()[:, None]
    return c


def train_centroids(df: DataFrame, nlist: int, iterations: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 42) -> np.ndarray:
    """k-means on a deterministic sample of max(65,536, 40 nlist) rows.

    A sample of up to ``DRIVER_ROWS`` is clustered at the driver. A larger one stays a table: the
    driver holds centroids and their sums only.
    """
    size = max(65_536, 40 * nlist)
    taken = sample(df.select(id_col, vec_col), id_col, size, seed)
    if size <= DRIVER_ROWS:
        return kmeans(np.array([r[0] for r in taken.select(vec_col).collect()], np.float64), nlist, iterations, seed)
    start = np.array([r[0] for r in sample(df.select(id_col, vec_col), id_col, nlist, seed).select(vec_col).collect()], np.float64)
    # the sample is read at every step
    return lloyd(stash(taken, "sample"), start, iterations, id_col, vec_col)


@dataclass
class IvfIndex:
    """Vectors with their list and code. Residuals are taken from the stored centroids."""

    rows: DataFrame  # id, list_id, code, v
    centroids: np.ndarray
    book: Codebook
    metric: str = "cosine"
    residual: bool = True
    options: dict = field(default_factory=dict)


def save(index: IvfIndex, path: str) -> IvfIndex:
    """Write the rows sorted by list and the rest as one row; returns the index that reads them.

    Files and row groups hold neighbouring lists, so a filter on lists skips the others.
    """
    spark = index.rows.sparkSession
    index.rows.repartitionByRange("list_id", "id").sortWithinPartitions("list_id", "id").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/rows")
    out = io.BytesIO()
    np.save(out, index.centroids)
    head = (index.metric, index.residual, bytearray(out.getvalue()), bytearray(index.book.to_bytes()))
    spark.createDataFrame([head], "metric string, residual boolean, centroids binary, book binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> IvfIndex:
    head = spark.read.parquet(f"{path}/head").first()
    return IvfIndex(spark.read.parquet(f"{path}/rows"), np.load(io.BytesIO(bytes(head["centroids"]))), Codebook.from_bytes(bytes(head["book"])), head["metric"], head["residual"])


def insert(index: IvfIndex, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> IvfIndex:
    """The index with further rows, in their nearest lists and coded with the codebook as it is."""
    more = build(df, index.centroids, index.book, index.metric, index.residual, id_col, vec_col)
    return IvfIndex(index.rows.unionByName(more.rows), index.centroids, index.book, index.metric, index.residual)


def build(df: DataFrame, centroids: np.ndarray, book: Codebook, metric: str = "cosine", residual: bool = True, id_col: str = "vec_id", vec_col: str = "embedding") -> IvfIndex:
    """Assign, code residuals (or the vectors themselves) and lay rows out by list."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    shared = df.sparkSession.sparkContext.broadcast((centroids, book))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, own = shared.value
        for batch in batches:
            x = matrix(batch.column(1), c.shape[1])
            lists = nearest(c, x)
            codes = own.encode(x - c[lists] if residual else x)
            packed = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * own.m), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.int64()), packed, batch.column(1)], ["id", "list_id", "code", "v"])

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return IvfIndex(source.mapInArrow(run, "id long, list_id long, code array<smallint>, v array<double>"), centroids, book, metric, residual)


def _probes(q: np.ndarray, c: np.ndarray, nprobe: int) -> np.ndarray:
    """The nprobe nearest lists of each query."""
    return np.argsort(np.round(distances(q, c, "l2"), 12), axis=1, kind="stable")[:, :nprobe] if len(q) else np.zeros((0, nprobe), np.int64)


def _askers(probes: np.ndarray) -> dict[int, list[int]]:
    """The queries that probe each list."""
    asked: dict[int, list[int]] = {}
    for n, own in enumerate(probes.tolist()):
        for x in own:
            asked.setdefault(x, []).append(n)
    return asked


def _code_distances(book: Codebook, table: np.ndarray | None, codes: np.ndarray, q: np.ndarray, centroid: np.ndarray, metric: str, residual: bool) -> np.ndarray:
    """Distances of a query from the codes of one list; ``table`` is the query's own."""
    sub = np.arange(book.m)
    if metric == "l2" and residual:
        return book.tables((q - centroid)[None], "l2")[0][sub, codes].sum(1)
    return table[sub, codes].sum(1) - (q @ centroid if residual else 0)


def slack(index: IvfIndex, queries: DataFrame, k: int, nprobe: int, share: float, id_col: str = "vec_id", vec_col: str = "embedding", rows: int = MARGIN_QUERIES) -> float:
    """How much farther than the k-th nearest vector the codes of a ``share`` of the k nearest seem to be.

    Measured by comparing a bounded sample of the queries with all vectors; neighbours in lists that
    a query doesn't probe don't count.
    """
    c, book, metric, residual = index.centroids, index.book, index.metric, index.residual
    got = sample(queries.select(id_col, vec_col), id_col, rows).collect()
    if not got:
        return 0.0
    shared = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        tables, asked = book.tables(q, metric if metric == "l2" and not residual else "ip"), _askers(_probes(q, c, nprobe))
        for batch in batches:
            of, codes, x = batch.column(1).to_numpy(zero_copy_only=False), matrix(batch.column(2), book.m).astype(np.int64), matrix(batch.column(3), q.shape[1])
            true = distances(q, x, metric)
            nearest_k = np.argsort(true, axis=1, kind="stable")[:, :k]
            for n, rows in enumerate(nearest_k):
                seen = np.array([_code_distances(book, tables[n], codes[i : i + 1], q[n], c[of[i]], metric, residual)[0] if n in asked.get(int(of[i]), ()) else np.inf for i in rows])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), qids[n])), batch.column(0).take(pa.array(rows)), pa.array(true[n, rows]), pa.array(seen)], ["qid", "id", "distance", "seen"])

    best = top_k(index.rows.select("id", "list_id", "code", "v").mapInArrow(run, "qid long, id long, distance double, seen double"), k, [F.col("distance"), F.col("id")])
    near = best.withColumn("last", F.max("distance").over(Window.partitionBy("qid"))).where(F.col("seen") < float("inf"))
    beyond = sorted(r[0] for r in near.select(F.col("seen") - F.col("last")).collect())  # k of each query in the sample
    return max(0.0, beyond[min(len(beyond) - 1, int(np.ceil(share * len(beyond))))]) if beyond else 0.0


def search(index: IvfIndex, queries: DataFrame, k: int = 10, nprobe: int = 32, rerank: bool = True, rerank_k: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", digits: int = 6, share: float = 0.0) -> DataFrame:
    """(qid, rank, id, distance): codes of the nprobe nearest lists are scored, then the best R stored
    vectors exactly (R = max(rerank_k, k); without rerank the order of codes stands).

    A fixed R finds fewer neighbours the more rows there are. With ``share``, each task compares the
    best R, and beyond them all rows whose codes lie within ``slack`` of its k-th best: as many as it
    takes to find that share of the neighbours in probed lists.

    Only rows of probed lists are read from a table laid out by list: the pushed filter names them
    while they are few, and a join with the probe table selects them in any case.
    """
    # plain values: the index holds a table, which workers can't have
    c, book, metric, residual = index.centroids, index.book, index.metric, index.residual
    nprobe = max(1, min(nprobe, len(c)))
    keep = max(rerank_k, k) if rerank else k
    most = k if share else keep
    order = [F.col("distance"), F.col("id")]
    every: set[int] = set()
    margin = slack(index, queries, k, nprobe, share, id_col, vec_col) if rerank and share else None

    def candidates(shared: Broadcast) -> DataFrame:
        qids, q = shared.value
        probes = _probes(q, c, nprobe)
        lists = sorted(set(probes.ravel().tolist()))
        every.update(lists)
        rows = index.rows.where(F.col("list_id").isin(lists)) if len(lists) <= MAX_NAMED_LISTS else index.rows

        def compared(q: np.ndarray, seen: np.ndarray, rows: np.ndarray, x: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Distances and ids of the vectors whose codes say that they may be among the k nearest."""
            exact = lambda own: np.round(distances(q[None], x[own], metric)[0], digits) + 0.0
            first = np.argpartition(seen, keep - 1)[:keep] if len(seen) > keep else np.arange(len(seen))
            d = exact(first)
            known = np.append(best, d)
            limit = np.partition(known, k - 1)[k - 1] + margin if len(known) >= k else np.inf
            more = seen <= limit
            more[first] = False
            more = np.flatnonzero(more)
            return np.append(d, exact(more)), np.append(rows[first], rows[more])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            tables = book.tables(q, metric if metric == "l2" and not residual else "ip") if len(q) else None
            asked = _askers(probes)
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                ids, of = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                codes = matrix(batch.column(2), book.m).astype(np.int64)
                vectors = matrix(batch.column(3), q.shape[1]) if margin is not None else None
                for x in np.unique(of):
                    if int(x) not in asked:
                        continue
                    here = of == x
                    own, rows = codes[here], ids[here]
                    for n in asked[int(x)]:
                        d = _code_distances(book, tables[n], own, q[n], c[x], metric, residual)
                        old = best.get(n, (np.zeros(0), np.zeros(0, np.int64)))
                        if margin is None:
                            d, i = np.round(d, digits) + 0.0, rows
                        else:
                            d, i = compared(q[n], d, rows, vectors[here], old[0])
                        d, i = np.append(old[0], d), np.append(old[1], i)
                        order = np.lexsort((i, d))[:most]
                        best[n] = d[order], i[order]
            ns = [n for n in best for _ in best[n][0]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[np.array(ns, np.int64)]), pa.array(np.concatenate([b[1] for b in best.values()] or [np.zeros(0, np.int64)])), pa.array(np.concatenate([b[0] for b in best.values()] or [np.zeros(0)]))],
                ["qid", "id", "distance"],
            )

        names = ["id", "list_id", "code"] + ([] if margin is None else ["v"])
        return top_k(rows.select(*names).mapInArrow(run, "qid long, id long, distance double"), most, order).select("qid", "rank", "id", "distance")

    first = in_parts(queries, id_col, vec_col, candidates)
    if margin is not None or not rerank:
        return first
    probed = index.rows.where(F.col("list_id").isin(sorted(every))) if len(every) <= MAX_NAMED_LISTS else index.rows
    return rescore(first.select("qid", "id"), probed.select("id", "v"), queries, k, metric, id_col, vec_col, digits)


def rescore(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str = "vec_id", vec_col: str = "embedding", digits: int = 6) -> DataFrame:
    """Candidates (qid, id) by the distances of their stored vectors (id, v)."""
    from ..functions.vectors import distance

    asked = queries.select(F.col(id_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("q"))
    joined = vectors.join(hint(candidates), "id").join(hint(asked), "qid")
    scored = joined.select("qid", "id", (F.round(distance(F.col("q"), F.col("v"), metric), digits) + 0.0).alias("distance"))
    return top_k(scored, k, [F.col("distance"), F.col("id")]).select("qid", "rank", "id", "distance")


def label_centroids(df: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> np.ndarray:
    """Mean vector of each label, in order of labels."""
    spread = df.select(label_col, F.posexplode(F.col(vec_col).cast("array<double>")).alias("d", "x")).groupBy(label_col, "d").agg(F.avg("x").alias("x"))
    lists = spread.groupBy(label_col).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).orderBy(label_col)
    return np.array([[p["x"] for p in r["v"]] for r in lists.collect()])


def list_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))


def ranked_probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(qid, list_id, probe_rank) for small tables (qid, q) and (list_id, c)."""
    from ..functions.vectors import l2sq

    d = queries.join(hint(centroids)).select("qid", "list_id", l2sq(F.col("q"), F.col("c")).alias("d"))
    return d.withColumn("probe_rank", F.row_number().over(Window.partitionBy("qid").orderBy("d", "list_id"))).where(F.col("probe_rank") <= nprobe)
