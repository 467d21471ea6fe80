"""Proximity graphs: sharded construction with levels, stored shards, and beam search over codes.

Vectors are dealt over shards of bounded size. A shard's graph is built in one Arrow group and
stored as one row: ids, codes, stored vectors and links as packed bytes. A search reads the rows
and walks each shard inside its task, so beams never leave a task and only each shard's best are
exchanged.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dense import distances, in_parts, top_k
from .quantize import Codebook, pack_vectors, unpack_vectors

#: Vectors of a shard, about.
SHARD_ROWS = 20_000
MAX_BEAM = 256
MAX_LEVEL = 16


def shard_count(n: int, rows: int = SHARD_ROWS) -> int:
    return max(1, -(-n // rows))


def prune(base: np.ndarray, candidates: np.ndarray, vectors: np.ndarray, most: int, alpha: float = 1.0, metric: str = "cosine") -> list[int]:
    """Positions kept of candidates (nearest first): c goes if alpha d(c, r) <= d(base, c) for a kept r."""
    to_base = distances(base[None], vectors[candidates], metric)[0]
    order = np.lexsort((candidates, to_base))
    ranked, near = np.asarray(candidates)[order], to_base[order]
    between = distances(vectors[ranked], vectors[ranked], metric)
    open_, kept = np.ones(len(ranked), bool), []
    while open_.any() and len(kept) < most:
        at = int(open_.argmax())
        kept.append(int(ranked[at]))
        open_[at] = False
        open_ &= alpha * between[at] > near
    return kept


def prune_neighbours(pairs: DataFrame, most: int, alpha: float = 1.0, metric: str = "cosine") -> DataFrame:
    """(node, kept array<long>) from rows (node, v, nbr, nbr_v), one group a node."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(rows["nbr_v"].to_numpy())
        kept = prune(np.asarray(rows["v"].iloc[0]), np.arange(len(rows)), vectors, most, alpha, metric)
        return pd.DataFrame({"node": [rows["node"].iloc[0]], "kept": [rows["nbr"].to_numpy()[kept]]})

    return pairs.groupBy("node").applyInPandas(run, "node long, kept array<long>")


def build_shard(x: np.ndarray, degree: int = 16, wide: int = 200, alpha: float = 1.0, metric: str = "cosine", most: int | None = None) -> list[np.ndarray]:
    """Adjacency from exact neighbour candidates, pruned, with pruned back-links of ``most`` at most."""
    n = len(x)
    most = most or 2 * degree
    links: list[list[int]] = []
    for at in range(0, n, 512):
        d = distances(x[at : at + 512], x, metric)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        take = min(wide, n - 1)
        near = np.argpartition(d, take - 1, axis=1)[:, :take] if 0 < take < n - 1 else np.argsort(d, axis=1)[:, :take]
        links += [prune(x[at + k], near[k], x, degree, alpha, metric) for k in range(len(d))]
    back: list[set[int]] = [set(own) for own in links]
    for node, own in enumerate(links):
        for c in own:
            back[c].add(node)
    return [np.array(prune(x[node], np.array(sorted(own)), x, most, alpha, metric) if len(own) > most else sorted(own), np.int64) for node, own in enumerate(back)]


def _drawn(ids: np.ndarray, seed: int) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(31))


def levels_of(ids: np.ndarray, seed: int = 42, degree: int = 16) -> np.ndarray:
    """The level of each node: floor(-ln u / ln degree), 16 at most, u drawn from a hash of its id."""
    u = ((_drawn(ids, seed) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum(np.floor(-np.log(u) / np.log(degree)), MAX_LEVEL).astype(np.int64)


def entry_set(ids: np.ndarray, n: int = 1024, seed: int = 42, degree: int = 16) -> np.ndarray:
    """The first n nodes by level (highest first) and hash."""
    return np.lexsort((_drawn(ids, seed), -levels_of(ids, seed, degree)))[:n]


def _packed(links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0] + [len(x) for x in links]).astype(np.int32)
    return ends, np.concatenate([*links, np.zeros(0, np.int64)]).astype(np.int32)


@dataclass
class Shard:
    """A graph over the nodes 0..n-1: ``links`` of level 0, those of upper levels, codes and stored vectors.

    Without stored vectors (None) distances are those of decoded codes.
    """

    ids: np.ndarray
    codes: np.ndarray
    vectors: np.ndarray | None
    links: list[np.ndarray]
    upper: list[dict[int, np.ndarray]] = field(default_factory=list)
    stored: str = "f16"

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, book: Codebook, degree: int = 16, most: int = 32, wide: int = 200, alpha: float = 1.0, metric: str = "cosine", seed: int = 42, stored: str = "f16") -> "Shard":
        """Exact candidates and pruning on every level; a level has the nodes drawn for it or higher."""
        links = build_shard(x, degree, max(wide, degree), alpha, metric, most)
        levels = levels_of(ids, seed, degree)
        upper = []
        for level in range(1, int(levels.max(initial=0)) + 1):
            own = np.flatnonzero(levels >= level)
            upper.append({int(own[k]): own[near] for k, near in enumerate(build_shard(x[own], degree, max(wide, degree), alpha, metric, degree))})
        return cls(ids, book.encode(x).astype(np.uint8), None if stored == "none" else unpack_vectors(pack_vectors(x, stored), stored, x.shape[1]), links, upper, stored)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        ends, flat = _packed(self.links)
        parts = {"ids": self.ids, "codes": self.codes, "ends": ends, "links": flat, "levels": np.array([len(self.upper)])}
        if self.vectors is not None:
            parts["vectors"] = np.array(pack_vectors(self.vectors, self.stored)).view(np.uint8).reshape(len(self.ids), -1)
            parts["dim"] = np.array([self.vectors.shape[1]])
        for k, level in enumerate(self.upper):
            nodes = np.array(sorted(level), np.int32)
            parts[f"nodes{k}"] = nodes
            parts[f"ends{k}"], parts[f"links{k}"] = _packed([level[n] for n in nodes.tolist()])
        np.savez(out, stored=np.array(self.stored), **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Shard":
        z = np.load(io.BytesIO(data))
        stored = str(z["stored"])
        split = lambda ends, flat: [x.astype(np.int64) for x in np.split(flat, ends[1:-1])] if len(ends) > 1 else []
        vectors = None
        if "vectors" in z.files:
            raw = z["vectors"]
            vectors = unpack_vectors([r.tobytes() for r in raw], stored, int(z["dim"][0]))
        upper = [dict(zip(z[f"nodes{k}"].tolist(), split(z[f"ends{k}"], z[f"links{k}"]), strict=True)) for k in range(int(z["levels"][0]))]
        return cls(z["ids"], z["codes"], vectors, split(z["ends"], z["links"]), upper, stored)

    def degree(self) -> float:
        """Average number of neighbours on level 0."""
        return sum(map(len, self.links)) / len(self.links) if self.links else 0.0

    def _points(self, book: Codebook) -> np.ndarray:
        """What stands for the nodes: stored vectors, else decoded codes."""
        return self.vectors if self.vectors is not None else book.restored(self.codes)

    def descend(self, table: np.ndarray) -> np.ndarray:
        """The node that a greedy walk over the upper levels ends at, and its neighbours there."""
        if not self.upper:
            return np.arange(min(1, len(self.ids)))
        score = lambda nodes: table[np.arange(table.shape[0]), self.codes[nodes]].sum(1)
        at = next(iter(self.upper[-1]))
        for level in reversed(self.upper):
            while True:
                around = np.append(at, level.get(at, np.zeros(0, np.int64)))
                near = score(around)
                # nodes of one code tie, and the walk stays
                if near.min() >= near[0]:
                    break
                at = int(around[near.argmin()])
        return np.unique(np.append(self.upper[0].get(at, np.zeros(0, np.int64)), at))

    def search(self, q: np.ndarray, table: np.ndarray, k: int, ef: int, width: int, mode: int, seeds: np.ndarray, metric: str, alive: np.ndarray | None = None) -> list[tuple[float, int]]:
        """(distance, node) of the best k nodes that are alive.

        Candidates are ranked by their codes (``table``). ``mode`` 0 keeps that order, 1 rescores the
        final list, 2 every expanded node, 3 rescores nodes as they are expanded and goes on from there.
        """
        if mode and self.vectors is None:
            mode = 0
        ef = max(ef, k)
        sub = np.arange(table.shape[0])
        exact = lambda nodes: distances(q[None], self.vectors[nodes], metric)[0].tolist()
        coded = lambda nodes: table[sub, self.codes[nodes]].sum(1).tolist()
        seen = np.zeros(len(self.ids), bool)
        seen[seeds] = True
        listed = heapq.nsmallest(ef, zip(coded(seeds), seeds.tolist(), strict=True))
        opened: set[int] = set()
        while True:
            fresh = [n for _, n in listed if n not in opened][: max(1, min(width, MAX_BEAM))]
            if not fresh:
                break
            opened.update(fresh)
            if mode == 3:
                true = dict(zip(fresh, exact(np.array(fresh)), strict=True))
                listed = sorted((true.get(n, d), n) for d, n in listed)
            around = np.unique(np.concatenate([self.links[n] for n in fresh]))
            around = around[~seen[around]]
            seen[around] = True
            if len(around):
                listed = heapq.nsmallest(ef, listed + list(zip(coded(around), around.tolist(), strict=True)))
        found = sorted(opened) if mode == 2 else [n for _, n in listed]
        if mode in (1, 2):
            listed = list(zip(exact(np.array(found, np.int64)), found, strict=True)) if found else []
        return heapq.nsmallest(k, [(d, n) for d, n in listed if alive is None or alive[n]])

    def insert(self, ids: np.ndarray, x: np.ndarray, book: Codebook, degree: int = 16, most: int = 32, wide: int = 200, alpha: float = 1.0, metric: str = "cosine") -> "Shard":
        """The shard with further nodes: each is coded, searched for, linked to pruned neighbours and linked back."""
        links = list(self.links)
        all_ids = np.concatenate([self.ids, ids])
        codes = np.concatenate([self.codes, book.encode(x).astype(np.uint8)])
        vectors = None if self.vectors is None else np.concatenate([self.vectors, unpack_vectors(pack_vectors(x, self.stored), self.stored, x.shape[1])])
        points = vectors if vectors is not None else book.restored(codes)
        so_far = lambda n: Shard(all_ids[:n], codes[:n], None if vectors is None else vectors[:n], links, self.upper, self.stored)
        for n in range(len(ids)):
            node = len(self.ids) + n
            mine: list[int] = []
            if node:
                now = so_far(node)
                table = book.tables(x[n][None], metric)[0]
                around = [c for _, c in now.search(x[n], table, max(wide, most), max(wide, most), 16, 0, now.descend(table), metric)]
                mine = prune(points[node], np.array(around), points, degree, alpha, metric)
            links.append(np.array(mine, np.int64))
            for c in mine:
                both = np.append(links[c], node)
                links[c] = both if len(both) <= most else np.array(prune(points[c], both, points, most, alpha, metric), np.int64)
        return so_far(len(all_ids))


@dataclass
class GraphIndex:
    """Stored shards (shard, n, data) and the codebook of their codes."""

    shards: DataFrame
    book: Codebook
    metric: str = "cosine"
    n_shards: int = 1
    degree: int = 16
    seed: int = 42

    def save(self, path: str) -> "GraphIndex":
        """Write the shards, one a file, and the rest as one row; returns the index that reads them."""
        spark = self.shards.sparkSession
        self.shards.write.mode("overwrite").parquet(f"{path}/shards")
        meta = (self.metric, self.n_shards, self.degree, self.seed, bytearray(self.book.to_bytes()))
        spark.createDataFrame([meta], "metric string, n_shards int, degree int, seed int, book binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
        return GraphIndex.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "GraphIndex":
        head = spark.read.parquet(f"{path}/head").first()
        return cls(spark.read.parquet(f"{path}/shards"), Codebook.from_bytes(bytes(head["book"])), head["metric"], head["n_shards"], head["degree"], head["seed"])


def _dealt(rows: DataFrame, n_shards: int, id_col: str, vec_col: str) -> DataFrame:
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return source.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int"))


def build(base: DataFrame, book: Codebook, degree: int = 16, most: int | None = None, ef_construction: int = 200, alpha: float = 1.0, metric: str = "cosine", stored: str = "f16", shards: int | None = None, seed: int = 42, id_col: str = "vec_id", vec_col: str = "embedding") -> GraphIndex:
    """An index of all rows; a shard of about ``SHARD_ROWS`` is built in one task."""
    n_shards = shards or shard_count(base.count())

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        x = np.stack(part["v"].to_numpy()).astype(np.float64)
        shard = Shard.build(part["id"].to_numpy(np.int64), x, book, degree, most or 2 * degree, ef_construction, alpha, metric, seed, stored)
        return pd.DataFrame({"shard": [key[0]], "n": [len(x)], "degree": [shard.degree()], "data": [shard.to_bytes()]})

    made = _dealt(base, n_shards, id_col, vec_col).groupBy("shard").applyInPandas(run, "shard int, n long, degree double, data binary")
    return GraphIndex(made, book, metric, n_shards, degree, seed)


def insert(index: GraphIndex, rows: DataFrame, ef_construction: int = 200, id_col: str = "vec_id", vec_col: str = "embedding") -> GraphIndex:
    """The index with further rows, by insertion into the shards that they belong to; others stay as they are."""
    book, metric, degree = index.book, index.metric, index.degree

    def run(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(new):
            return old
        new = new.sort_values("id", ignore_index=True)
        x = np.stack(new["v"].to_numpy()).astype(np.float64)
        ids = new["id"].to_numpy(np.int64)
        if len(old):
            shard = Shard.from_bytes(old["data"].iloc[0]).insert(ids, x, book, degree, 2 * degree, ef_construction, metric=metric)
        else:
            shard = Shard.build(ids, x, book, degree, 2 * degree, ef_construction, metric=metric)
        return pd.DataFrame({"shard": [new["shard"].iloc[0]], "n": [len(shard.ids)], "degree": [shard.degree()], "data": [shard.to_bytes()]})

    dealt = _dealt(rows, index.n_shards, id_col, vec_col)
    grown = index.shards.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(run, "shard int, n long, degree double, data binary")
    return GraphIndex(grown, book, metric, index.n_shards, degree, index.seed)


def average_degree(index: GraphIndex) -> DataFrame:
    """(nodes, degree) over all shards."""
    return index.shards.agg(F.sum("n").alias("nodes"), (F.sum(F.col("degree") * F.col("n")) / F.sum("n")).alias("degree"))


def search(index: GraphIndex, queries: DataFrame, k: int = 10, ef: int = 64, beam: int = 16, rerank: int = 2, entry_points: int = 1024, deleted: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(qid, rank, id, distance), approximately nearest.

    Beams start from the ``entry_points`` nodes of the highest levels, or with 0 from where a walk
    down the levels ends. Deleted ids route but aren't returned; they are sent to their shards.
    """
    book, metric, degree, seed = index.book, index.metric, index.degree, index.seed
    rows = index.shards.select("shard", "data")
    if deleted is not None:
        gone = deleted.select(F.col(id_col).cast("long").alias("id")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(index.n_shards)).cast("int"))
        rows = rows.join(gone.groupBy("shard").agg(F.collect_set("id").alias("gone")), "shard", "left").select("shard", "data", "gone")
    else:
        rows = rows.withColumn("gone", F.lit(None).cast("array<long>"))

    def walked(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            tables = book.tables(q, metric) if len(q) else []
            for batch in batches:
                for data, gone in zip(batch.column(1), batch.column(2), strict=True):
                    shard = Shard.from_bytes(data.as_py())
                    alive = ~np.isin(shard.ids, gone.as_py()) if gone.is_valid else None
                    entries = entry_set(shard.ids, min(entry_points, max(1, len(shard.ids) // 8)), seed, degree) if entry_points else None
                    found = [
                        (qids[n], shard.ids[node], round(d, digits) + 0.0)
                        for n in range(len(q))
                        for d, node in shard.search(q[n], tables[n], k, ef, beam, rerank, entries if entries is not None else shard.descend(tables[n]), metric, alive)
                    ]
                    columns = list(zip(*found, strict=True)) or [[]] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["qid", "id", "distance"])

        return top_k(rows.mapInArrow(run, "qid long, id long, distance double"), k, [F.col("distance"), F.col("id")]).select("qid", "rank", "id", "distance")

    return in_parts(queries, id_col, vec_col, walked)


def shard_neighbours(base: DataFrame, k: int = 16, metric: str = "cosine", shards: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(node, nbr, distance): the k nearest of each row in its shard, in blocks of one product each."""
    n_shards = shards or shard_count(base.count())

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        x, ids = np.stack(part["v"].to_numpy()).astype(np.float64), part["id"].to_numpy(np.int64)
        found = []
        for at in range(0, len(x), 512):
            d = np.round(distances(x[at : at + 512], x, metric), 6) + 0.0
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, : min(k, len(x) - 1)]
            found.append(pd.DataFrame({"node": np.repeat(ids[at : at + 512], near.shape[1]), "nbr": ids[near.ravel()], "distance": np.take_along_axis(d, near, 1).ravel()}))
        return pd.concat(found)

    return _dealt(base, n_shards, id_col, vec_col).groupBy("shard").applyInPandas(run, "node long, nbr long, distance double")


def chain(vectors: np.ndarray) -> list[int]:
    """Greedy order: after each vector the unseen one with the largest product."""
    left, order = set(range(1, len(vectors))), [0] if len(vectors) else []
    while left:
        products = vectors @ vectors[order[-1]]
        order.append(max(left, key=lambda n: (products[n], -n)))
        left.remove(order[-1])
    return order


def expand(frontier: DataFrame, adjacency: DataFrame, visited: DataFrame) -> DataFrame:
    """One round over tables: neighbours (qid, node) of a frontier, without visited ones."""
    step = frontier.join(adjacency, "node").select("qid", F.explode("nbrs").alias("node")).distinct()
    return step.join(visited, ["qid", "node"], "left_anti")


def walk(start: DataFrame, adjacency: DataFrame, rounds: int) -> DataFrame:
    """(qid, node, round) of all nodes within ``rounds`` links of the start (qid, node), over tables."""
    seen = start.select("qid", "node").distinct().withColumn("round", F.lit(0))
    frontier = seen.select("qid", "node")
    for n in range(1, rounds + 1):
        frontier = expand(frontier, adjacency, seen.select("qid", "node"))
        seen = seen.unionByName(frontier.withColumn("round", F.lit(n)))
    return seen
