"""Late interaction: token vectors, residual codec, probes, WARP and PLAID scoring.

Tables: tokens (doc_id, pos, v), queries (qid, i, q), centroids (cid, c). A stored index keeps the
coded tokens sorted by list, so a search scans the lists it probes. Queries and centroids are counted
once, and what derives from them is broadcast where these counts bound it; scores are folded per
(query, document, query token) before they are exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import add, bucketize, dot, normalize_floor, subtract
from ..sources.scratch import stash
from .dense import TILE_BYTES, in_parts, matrix
from .lexical import MAX_BROADCAST_QUERIES, hint, rank
from .quantiles import quantiles
from .quantize import half_round_trip, kmeans, sample

DIGITS = 6
#: Lists that a filter names one by one.
MAX_NAMED_LISTS = 1000


def _best() -> list[Column]:
    return [F.desc("score"), F.asc("doc_id")]


def maxsim(tokens: DataFrame, queries: DataFrame, k: int, vec: str = "v") -> DataFrame:
    """(qid, rank, doc_id, score): sum over query tokens of the best product with a document's tokens.

    Query tokens (qid, i, q) are broadcast in parts; a task multiplies them with a batch of tokens at
    once and hands on one row a query token and document that it has seen.
    """
    asked = queries.select(F.struct("qid", "i").alias("key"), "q")
    source = tokens.select("doc_id", F.col(vec).alias("v"))

    def scored(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, q = shared.value
            step = max(1, TILE_BYTES // (8 * max(1, len(keys))))
            for batch in batches if len(keys) else ():
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    docs, place = np.unique(part.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                    order = np.argsort(place, kind="stable")
                    best = np.maximum.reduceat((q @ matrix(part.column(1), q.shape[1]).T)[:, order], np.searchsorted(place[order], np.arange(len(docs))), axis=1)
                    n = len(docs)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[:, 0], n)), pa.array(np.repeat(keys[:, 1], n)), pa.array(np.tile(docs, len(keys))), pa.array(best.ravel())], ["qid", "i", "doc_id", "s"])

        return _sum_of_best(source.mapInArrow(run, "qid long, i long, doc_id long, s double"), k)

    return in_parts(asked, "key", "q", scored)


def _sum_of_best(s: DataFrame, k: int) -> DataFrame:
    best = s.groupBy("qid", "doc_id", "i").agg(F.max("s").alias("s"))
    scored = best.groupBy("qid", "doc_id").agg(F.round(F.sum("s"), DIGITS).alias("score"))
    return rank(scored, k, _best()).select("qid", "rank", "doc_id", "score")


def _matrix_of(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors of centroids (cid, c), in order, at the driver: their number times the dimension."""
    got = centroids.select(F.col("cid").cast("long").alias("cid"), F.col("c").cast("array<double>").alias("c")).orderBy("cid").toArrow()
    return got["cid"].to_numpy(), matrix(got["c"].combine_chunks()) if got.num_rows else np.zeros((0, 1))


def centroid_matrix(centroids: DataFrame) -> np.ndarray:
    """The vectors of centroids (cid, c), in order of cid, at the driver."""
    return _matrix_of(centroids)[1]


def best_of(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The row of c with the largest product for each row of v, the first on ties."""
    out = np.empty(len(v), np.int64)
    step = max(1, TILE_BYTES // (8 * max(1, len(c))))
    for at in range(0, len(v), step):
        out[at : at + step] = (v[at : at + step] @ c.T).argmax(1)
    return out


def assign(tokens: DataFrame, centroids: DataFrame, cells: np.ndarray | None = None, probes: int = 4) -> DataFrame:
    """tokens with cid: the largest product, the lowest centroid on ties.

    Centroids are broadcast as one matrix (they are few next to tokens: 16 sqrt of them) and
    multiplied with a batch of tokens at once, so nothing is exchanged. With coarse ``cells`` (see
    ``coarse_cells``) only the centroids of each token's ``probes`` best cells are compared.
    """
    cids, c = _matrix_of(centroids)
    shared = tokens.sparkSession.sparkContext.broadcast((cids, c, cells, None if cells is None else best_of(c, cells)))
    names = [n for n in tokens.columns if n != "cid"]
    at = names.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, c, cells, cell_of = shared.value
        for batch in batches:
            v = matrix(batch.column(at), c.shape[1])
            own = best_of(v, c) if cells is None else _best_in_cells(v, c, cells, cell_of, probes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cids[own])], [*names, "cid"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*names).schema)
    return tokens.select(*names).mapInArrow(run, f"{schema}, cid long")


def coarse_cells(c: np.ndarray, n: int = 0, iterations: int = 4, seed: int = 42) -> np.ndarray:
    """Cells of centroids for a two-level search: unit means of their k-means, sqrt of their number unless given."""
    cells = kmeans(c, n or max(1, int(np.sqrt(len(c)))), iterations, seed)
    return cells / np.maximum(np.linalg.norm(cells, axis=1, keepdims=True), 1e-12)


def _best_in_cells(v: np.ndarray, c: np.ndarray, cells: np.ndarray, cell_of: np.ndarray, probes: int) -> np.ndarray:
    near = np.argsort(-(v @ cells.T), axis=1, kind="stable")[:, :probes]
    best, score = np.zeros(len(v), np.int64), np.full(len(v), -np.inf)
    for cell in np.unique(near):
        rows, own = np.flatnonzero((near == cell).any(1)), np.flatnonzero(cell_of == cell)
        if len(own):
            products = v[rows] @ c[own].T
            first = products.argmax(1)
            top, pick = products[np.arange(len(rows)), first], own[first]
            better = (top > score[rows]) | ((top == score[rows]) & (pick < best[rows]))
            best[rows[better]], score[rows[better]] = pick[better], top[better]
    return best


def train_tokens(tokens: DataFrame, k: int, iterations: int = 4, seed: int = 42, rows: int = 65_536) -> DataFrame:
    """(cid, c): k-means of a sample of tokens by largest x c - |c|^2 / 2, then unit length and float16."""
    taken = sample(tokens.select(F.struct("doc_id", "pos").alias("key"), "v").withColumn("h", F.xxhash64("key")), "h", max(rows, 40 * k), seed)
    x = np.array([r[0] for r in taken.limit(rows).select("v").collect()], np.float64)
    c = kmeans(x, k, iterations, seed)
    c = half_round_trip(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float64)
    return tokens.sparkSession.createDataFrame([(n, row.tolist()) for n, row in enumerate(c)], "cid long, c array<double>")


@dataclass(frozen=True)
class Codec:
    """Bucket limits and values of the residuals, the same for all dimensions."""

    cutoffs: list[float]
    weights: list[float]
    threshold: float = 0.0

    @property
    def bits(self) -> int:
        return (len(self.cutoffs) + 1).bit_length() - 1


def residuals(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    return assigned.join(hint(centroids), "cid").withColumn("r", subtract(F.col("v"), F.col("c")))


def _codec(residual: DataFrame, bits: int) -> tuple[list[float | None], list[float | None], float | None]:
    """Cutoffs at quantiles i / B, weights at (i + 1/2) / B, and the 0.75 quantile of |r|'s norm, of all rows."""
    n = 1 << bits
    at = [i / n for i in range(1, n)] + [(i + 0.5) / n for i in range(n)]
    rows = residual.select("r", F.array(F.sqrt(dot(F.col("r"), F.col("r")))).alias("norm"))
    found = quantiles(rows, {"r": at, "norm": [0.75]})
    return found["r"][: n - 1], found["r"][n - 1 :], found["norm"][0]


def codec_table(residual: DataFrame, bits: int = 2) -> DataFrame:
    """One row: cutoffs, weights and threshold (see ``_codec``)."""
    return residual.sparkSession.createDataFrame([_codec(residual, bits)], "cutoffs array<double>, weights array<double>, threshold double")


def train_codec(residual: DataFrame, bits: int = 2) -> Codec:
    """Exact quantiles of the residuals of all tokens; without tokens all are 0."""
    cutoffs, weights, threshold = _codec(residual, bits)
    return Codec([x or 0.0 for x in cutoffs], [x or 0.0 for x in weights], threshold or 0.0)


def encode(residual: DataFrame, codec: Codec) -> DataFrame:
    return residual.withColumn("res", bucketize(F.col("r"), codec.cutoffs))


def decode(coded: DataFrame, codec: Codec) -> DataFrame:
    """Adds v_hat: centroid plus bucket values, normalised."""
    w = F.array(*[F.lit(float(x)) for x in codec.weights])
    return coded.withColumn("v_hat", normalize_floor(add(F.col("c"), F.transform("res", lambda b: F.element_at(w, b + 1)))))


def build(tokens: DataFrame, centroids: DataFrame, bits: int = 2) -> tuple[DataFrame, Codec]:
    """(doc_id, pos, cid, v_hat) of all tokens, and the codec, which is trained on all of them."""
    # training reads the tokens a few times
    rest = residuals(stash(assign(tokens, centroids), "assigned"), centroids)
    codec = train_codec(rest, bits)
    return decode(encode(rest, codec), codec).select("doc_id", "pos", "cid", "v_hat"), codec


def save(tokens: DataFrame, centroids: DataFrame, path: str, bits: int = 2) -> None:
    """Write the coded tokens ranged and sorted by list, the centroids, and what a search needs to know of each list."""
    stored = stash(centroids, "centroids")
    coded, codec = build(tokens, stored, bits)
    coded.repartitionByRange("cid", "doc_id", "pos").sortWithinPartitions("cid", "doc_id", "pos").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{path}/coded")
    spark = tokens.sparkSession
    stored.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(codec.cutoffs, codec.weights, codec.threshold)], "cutoffs array<double>, weights array<double>, threshold double").coalesce(1).write.mode("overwrite").parquet(f"{path}/codec")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(coded, centroids) of what ``save`` wrote."""
    return spark.read.parquet(f"{path}/coded"), spark.read.parquet(f"{path}/centroids")


def inverted_lists(coded: DataFrame) -> DataFrame:
    """(cid, doc_id), once each."""
    return coded.select("cid", "doc_id").distinct()


def list_lengths(coded: DataFrame, layout: str = "warp") -> DataFrame:
    """(cid, n): tokens (warp) or documents (plaid) of each list."""
    counted = coded if layout == "warp" else inverted_lists(coded)
    return counted.groupBy("cid").agg(F.count(F.lit(1)).alias("n_list"))


@dataclass(frozen=True)
class Batch:
    """Query tokens (qid, i, q) and centroids (cid, c) with their numbers, which bound what derives from them."""

    queries: DataFrame
    centroids: DataFrame
    n_tokens: int
    n_centroids: int
    cells: np.ndarray | None = None
    cprobe: int = 4

    @classmethod
    def of(cls, queries: DataFrame, centroids: DataFrame, cells: np.ndarray | None = None, cprobe: int = 4) -> "Batch":
        return cls(queries, centroids, *(df.limit(MAX_BROADCAST_QUERIES + 1).count() for df in (queries, centroids)), cells, cprobe)

    def hint(self, df: DataFrame, rows: int) -> DataFrame:
        """Broadcast ``df``, which has at most that many rows, if these are few."""
        return F.broadcast(df) if rows <= MAX_BROADCAST_QUERIES else df

    def scores(self) -> DataFrame:
        return centroid_scores(self.queries, self.centroids, self.cells, self.cprobe)


def centroid_scores(queries: DataFrame, centroids: DataFrame, cells: np.ndarray | None = None, cprobe: int = 4) -> DataFrame:
    """(qid, i, cid, s): products of query tokens and centroids, a block of tokens at once.

    Centroids are held by the driver and broadcast as one matrix (see ``assign``); each query token
    has one row a centroid, or with coarse ``cells`` one for each in its ``cprobe`` best cells.
    """
    cids, c = _matrix_of(centroids)
    shared = queries.sparkSession.sparkContext.broadcast((cids, c, cells, None if cells is None else best_of(c, cells)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, c, cells, cell_of = shared.value
        step = max(1, TILE_BYTES // (32 * max(1, len(c))))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                q = matrix(part.column(2), c.shape[1])
                s, asked = q @ c.T, np.ones((len(q), len(c)), bool)
                if cells is not None:
                    near = np.zeros((len(q), len(cells)), bool)
                    np.put_along_axis(near, np.argsort(-(q @ cells.T), axis=1, kind="stable")[:, :cprobe], True, 1)
                    asked = near[:, cell_of]
                row, column = np.nonzero(asked)
                qid, i = (part.column(k).to_numpy(zero_copy_only=False)[row] for k in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(i), pa.array(cids[column]), pa.array(s[row, column])], ["qid", "i", "cid", "s"])

    return queries.select(F.col("qid").cast("long"), F.col("i").cast("long"), "q").mapInArrow(run, "qid long, i long, cid long, s double")


def probe(scores: DataFrame, nprobe: int = 4) -> DataFrame:
    """(qid, i, cid, s, probe_rank, impute, top): the nprobe best centroids of each query token; impute is
    the score of the last of them."""
    token = Window.partitionBy("qid", "i")
    ranked = scores.withColumn("probe_rank", F.row_number().over(token.orderBy(F.desc("s"), "cid"))).where(F.col("probe_rank") <= nprobe)
    return ranked.withColumn("impute", F.min("s").over(token)).withColumn("top", F.max("s").over(token))


def stop_tokens(probes: DataFrame, lengths: DataFrame, n_docs: int, stoplist: float, floor: int = 64) -> DataFrame:
    """(qid, i, mean_length, stopped): tokens whose probed lists are long on average; none if all are."""
    joined = probes.join(lengths, "cid", "left")
    mean = joined.groupBy("qid", "i").agg(F.avg(F.coalesce("n_list", F.lit(0))).alias("mean_length"))
    long = F.col("mean_length") > max(stoplist * n_docs, float(floor))
    every = F.min(long.cast("int")).over(Window.partitionBy("qid")) == 1
    return mean.withColumn("stopped", long & ~every & F.lit(stoplist > 0))


def _query_plan(batch: Batch, nprobe: int, impute: bool, tcs: float, stopped: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores; probed (qid, cid); own (qid, i, cid, and the token's impute)."""
    scores = batch.scores()
    probes = probe(scores, nprobe)
    if stopped is None:
        probes = probes.withColumn("stopped", F.lit(False))
    else:
        probes = probes.join(batch.hint(stopped.select("qid", "i", "stopped"), batch.n_tokens), ["qid", "i"])
    probes = probes.withColumn("impute", F.when(F.col("stopped"), F.col("top")).otherwise(F.col("impute") if impute else F.lit(0.0)))
    probed = probes.where("NOT stopped").select("qid", "cid").distinct()
    if tcs > 0:
        kept = scores.groupBy("qid", "cid").agg(F.max("s").alias("m")).where(F.col("m") >= tcs)
        probed = probed.join(kept.select("qid", "cid"), ["qid", "cid"], "left_semi")
    return scores, probed, probes


def _fold(entries: DataFrame, probes: DataFrame, batch: Batch) -> DataFrame:
    """(qid, doc_id, score) from entries (qid, doc_id, i, s, own)."""
    floors = probes.groupBy("qid", "i").agg(F.first("impute").alias("impute"))
    base = floors.groupBy("qid").agg(F.sum("impute").alias("base"))
    best = entries.groupBy("qid", "doc_id", "i").agg(F.max("s").alias("s"), F.max("own").alias("own"))
    gain = F.when(F.col("own"), F.col("s")).otherwise(F.greatest("s", "impute")) - F.col("impute")
    summed = best.join(batch.hint(floors, batch.n_tokens), ["qid", "i"]).groupBy("qid", "doc_id").agg(F.sum(gain).alias("gain"))
    return summed.join(batch.hint(base, batch.n_tokens), "qid").select("qid", "doc_id", F.round(F.col("base") + F.col("gain"), DIGITS).alias("score"))


def _of_lists(coded: DataFrame, probed: DataFrame) -> DataFrame:
    """The rows of the probed lists; few lists are named in the scan's filter."""
    lists = [r[0] for r in probed.select("cid").distinct().limit(MAX_NAMED_LISTS + 1).collect()]
    return coded.where(F.col("cid").isin(lists)) if len(lists) <= MAX_NAMED_LISTS else coded


def _entries(coded: DataFrame, batch: Batch, probed: DataFrame, probes: DataFrame, nprobe: int, score: Column, cross: bool, extra: DataFrame | None = None) -> DataFrame:
    """One row a probed posting and query token; without ``cross`` only the tokens that probed the list."""
    most = batch.n_tokens * nprobe
    own = probes.where("NOT stopped").select("qid", "i", "cid", F.lit(True).alias("own"))
    rows = _of_lists(coded, probed).join(batch.hint(probed, most), "cid").join(batch.hint(batch.queries, batch.n_tokens), "qid")
    rows = rows.join(batch.hint(own, most), ["qid", "i", "cid"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    if extra is not None:
        rows = rows.join(batch.hint(extra, batch.n_tokens * batch.n_centroids), ["qid", "i", "cid"])
    if not cross:
        rows = rows.where("own")
    return rows.select("qid", "doc_id", "i", score.alias("s"), "own")


def warp_scores(coded: DataFrame, queries: DataFrame, centroids: DataFrame, nprobe: int = 4, impute: bool = True, cross: bool = True, tcs: float = 0.0, stopped: DataFrame | None = None, cells: np.ndarray | None = None, cprobe: int = 4) -> DataFrame:
    """(qid, doc_id, score); with coarse ``cells`` only centroids of each token's ``cprobe`` best cells are probed."""
    batch = Batch.of(queries, centroids, cells, cprobe)
    _, probed, probes = _query_plan(batch, nprobe, impute, tcs, stopped)
    return _fold(_entries(coded, batch, probed, probes, nprobe, dot(F.col("q"), F.col("v_hat")), cross), probes, batch)


def warp(coded: DataFrame, queries: DataFrame, centroids: DataFrame, k: int = 10, rerank: int = 0, **options) -> DataFrame:
    """WARP search; with ``rerank`` the best of that number are rescored on all their tokens."""
    scored = warp_scores(coded, queries, centroids, **options)
    if not rerank:
        return rank(scored, k, _best()).select("qid", "rank", "doc_id", "score")
    most = max(rerank, k)
    return rescore(rank(scored, most, _best()).select("qid", "doc_id"), coded, queries, k, most)


def rescore(candidates: DataFrame, coded: DataFrame, queries: DataFrame, k: int, each: int) -> DataFrame:
    """Exact MaxSim on decompressed tokens of the candidates (qid, doc_id), ``each`` a query at most."""
    n = queries.limit(MAX_BROADCAST_QUERIES + 1).count()
    small = lambda df, rows: F.broadcast(df) if rows <= MAX_BROADCAST_QUERIES else df
    s = coded.join(small(candidates, n * each), "doc_id").join(small(queries, n), "qid").select("qid", "doc_id", "i", dot(F.col("q"), F.col("v_hat")).alias("s"))
    return _sum_of_best(s, k)


def plaid(coded: DataFrame, queries: DataFrame, centroids: DataFrame, k: int = 10, nprobe: int = 4, approx: str = "codes", ndocs: int = 256, impute: bool = True, cross: bool = True, tcs: float = 0.0, stopped: DataFrame | None = None, cells: np.ndarray | None = None, cprobe: int = 4) -> DataFrame:
    """PLAID search: documents of probed lists are ranked by centroid scores, the best ``ndocs`` exactly.

    ``approx`` "codes" scores all tokens of a candidate by their centroids; "ivf" only those in
    probed lists, with imputed scores for the rest.
    """
    batch = Batch.of(queries, centroids, cells, cprobe)
    scores, probed, probes = _query_plan(batch, nprobe, impute, tcs, stopped)
    if approx == "ivf":
        ranked = _fold(_entries(inverted_lists(coded), batch, probed, probes, nprobe, F.col("sc"), cross, scores.withColumnRenamed("s", "sc")), probes, batch)
    elif approx == "codes":
        found = inverted_lists(_of_lists(coded, probed)).join(batch.hint(probed, batch.n_tokens * nprobe), "cid").select("qid", "doc_id").distinct()
        rows = coded.select("doc_id", "cid").distinct().join(found, "doc_id").join(batch.hint(scores, batch.n_tokens * batch.n_centroids), ["qid", "cid"])
        best = rows.groupBy("qid", "doc_id", "i").agg(F.max("s").alias("s"))
        ranked = best.groupBy("qid", "doc_id").agg(F.round(F.sum("s"), DIGITS).alias("score"))
    else:
        raise ValueError(f"unknown approximation {approx}")
    most = max(ndocs, k)
    return rescore(rank(ranked, most, _best()).select("qid", "doc_id"), coded, queries, k, most)
