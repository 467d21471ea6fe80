"""Index snapshots: immutable base, delta, tombstones and metadata, and searches over them.

A snapshot is a folder with ``base``, ``delta`` and ``tombstones`` (Parquet), ``meta`` (JSON, one
row) and ``index``: the shards of a graph or the inverted lists of the base, built when the
snapshot is made or at the first search. Vectors lie in ``base`` and ``delta`` as bytes of their
stored form, and searches see them as stored. Writers only append; ``compact`` writes a new
snapshot. A search asks the index for the base and scans the delta, which holds what has come
since. Readers refuse formats newer than theirs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense, graph, ivf, quantize

FORMAT_VERSION = 3
# Parameters that an index knows, with their defaults.
PARAMETERS = {
    "dim": None, "pq_m": None, "M": 16, "M0": 32, "ef_construction": 200, "metric": "cosine", "store_vectors": "f16", "layout": "exact", "entry_points": 1024,
    "dnpq_train": 65_536, "kmeans_iters": 25, "opq": 0, "seed": 42, "alpha": 1.0, "nlist": 0, "ivf_residual": 1,
    "ef_search": 64, "beam": 16, "nprobe": 32, "rerank_k": 64,
}
LAYOUTS = ("exact", "graph", "ivf")


def check_parameters(given: dict) -> dict:
    """Defaults and given values; unknown keys and values out of range raise."""
    unknown = given.keys() - PARAMETERS.keys()
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    out = PARAMETERS | given
    if out["metric"] not in ("cosine", "ip", "l2"):
        raise ValueError(f"unknown metric {out['metric']}")
    if out["layout"] not in LAYOUTS:
        raise ValueError(f"unknown layout {out['layout']}")
    if out["store_vectors"] not in ("none", "int8", "f16", "f32"):
        raise ValueError(f"unknown vector storage {out['store_vectors']}")
    if not 2 <= out["M"] <= 128:
        raise ValueError("M must be from 2 to 128")
    if out["dim"] is not None and out["dim"] < 1:
        raise ValueError("dim must be positive")
    if out["dim"] and out["pq_m"] and out["dim"] % out["pq_m"]:
        raise ValueError("pq_m must divide dim")
    return out


def live(base: DataFrame, delta: DataFrame | None, tombstones: DataFrame | None, id_col: str) -> DataFrame:
    """Base and delta rows that aren't deleted; a delta row replaces the base row of its id.

    Delta rows have ``seq``; of an id the last counts. Tombstones (id, seq) delete what is older.
    """
    rows = base
    if delta is not None:
        last = delta.groupBy(id_col).agg(F.max_by(F.struct(*base.columns), "seq").alias("r"), F.max("seq").alias("seq"))
        if tombstones is not None:
            last = last.join(_deletions(tombstones, id_col), id_col, "left").where("deleted_at IS NULL OR deleted_at < seq").drop("deleted_at")
        fresh = last.select("r.*")
        rows = base.join(delta.select(id_col).distinct(), id_col, "left_anti")
        if tombstones is not None:
            rows = rows.join(tombstones.select(id_col).distinct(), id_col, "left_anti")
        return rows.select(*base.columns).unionByName(fresh)
    return rows if tombstones is None else rows.join(tombstones.select(id_col).distinct(), id_col, "left_anti")


def _deletions(tombstones: DataFrame, id_col: str) -> DataFrame:
    return tombstones.groupBy(id_col).agg(F.max("seq").alias("deleted_at"))


@dataclass
class Snapshot:
    spark: SparkSession
    path: str
    parameters: dict = field(default_factory=dict)
    id_col: str = "vec_id"
    vec_col: str = "embedding"

    @classmethod
    def create(cls, df: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", **parameters) -> "Snapshot":
        """Write the base, sorted by id so that row groups can be skipped, and the index; repeated ids raise.

        With ``store_vectors`` "none" the index keeps codes only: the layout must have some, and
        neither exact searches nor ``compact`` are possible.
        """
        known = check_parameters(parameters)
        first = df.select(F.size(vec_col)).where(F.col(vec_col).isNotNull()).first()
        if first is not None and known["dim"] not in (None, first[0]):
            raise ValueError(f"vectors have {first[0]} elements, not {known['dim']}")
        known["dim"] = first[0] if first is not None else known["dim"]
        if known["store_vectors"] == "none" and known["layout"] == "exact":
            raise ValueError("an exact layout needs stored vectors")
        out = cls(df.sparkSession, path, known, id_col, vec_col)
        repeated = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
        if repeated:
            raise ValueError(f"{id_col} {repeated[0][0]} already exists")
        if known["store_vectors"] == "none":
            # the codes are made of what isn't kept
            out._build(df)
        out._stored(df).repartitionByRange(id_col).sortWithinPartitions(id_col).write.mode("errorifexists").parquet(f"{path}/base")
        out._write_meta()
        return out

    def _stored(self, df: DataFrame) -> DataFrame:
        return quantize.packed(df, self.vec_col, self.parameters["store_vectors"])

    def _write_meta(self) -> None:
        row = json.dumps({"format_version": FORMAT_VERSION, "id_col": self.id_col, "vec_col": self.vec_col, "parameters": self.parameters})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Snapshot":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if meta["format_version"] > FORMAT_VERSION:
            raise ValueError(f"format {meta['format_version']} is newer than {FORMAT_VERSION}")
        return cls(spark, path, meta["parameters"], meta["id_col"], meta["vec_col"])

    def _there(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _table(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{name}") if self._there(name) else None

    def _seq(self) -> int:
        tops = [t.agg(F.max("seq")).first()[0] for t in (self._table("delta"), self._table("tombstones")) if t is not None]
        return 1 + max([t for t in tops if t is not None], default=0)

    def _visible(self, df: DataFrame) -> DataFrame:
        """With vectors as they are stored; without any if none are."""
        form = self.parameters["store_vectors"]
        return df if form == "none" or self.vec_col not in df.columns else quantize.unpacked(df, self.vec_col, form, self.parameters["dim"])

    def rows(self, without: str | None = None) -> DataFrame:
        """The live rows; ``without`` names a batch of the delta that is left out."""
        delta = self._table("delta")
        if delta is not None and without is not None:
            delta = delta.where(F.col("batch") != without)
        base = self._table("base")
        if self.parameters["store_vectors"] == "none" and delta is not None:
            delta = delta.select(*base.columns, "seq")
        return self._visible(live(base, delta, self._table("tombstones"), self.id_col))

    def insert(self, df: DataFrame) -> None:
        """Append rows; an id that is live raises."""
        clash = self.rows().select(self.id_col).join(df.select(self.id_col), self.id_col, "left_semi").limit(1).collect()
        if clash:
            raise ValueError(f"{self.id_col} {clash[0][0]} already exists")
        self._append(df)

    def in_delta(self, df: DataFrame, seq: int) -> DataFrame:
        """Rows as the delta has them. Where the base keeps no vectors the delta keeps float16 ones: it
        is searched by scanning until ``compact`` codes it."""
        form = self.parameters["store_vectors"]
        return quantize.packed(df, self.vec_col, "f16" if form == "none" else form).withColumn("seq", F.lit(seq).cast("long"))

    def _append(self, df: DataFrame) -> None:
        seq = self._seq()
        self.in_delta(df, seq).write.mode("append").parquet(f"{self.path}/delta/batch=m{seq}")

    def delete(self, ids: DataFrame) -> None:
        """Mark ids as deleted; absent ones don't matter."""
        ids.select(self.id_col).withColumn("seq", F.lit(self._seq()).cast("long")).write.mode("append").parquet(f"{self.path}/tombstones")

    def update(self, df: DataFrame) -> None:
        self.delete(df.select(self.id_col))
        self._append(df)

    def compact(self, path: str) -> "Snapshot":
        """A new snapshot of the live rows."""
        if self.parameters["store_vectors"] == "none":
            raise ValueError("no vectors are stored to make a new base of")
        return Snapshot.create(self.rows(), path, self.id_col, self.vec_col, **self.parameters)

    def build(self) -> None:
        """Build the index of the base, unless it is there or the layout has none."""
        if self.parameters["layout"] != "exact" and not self._there("index/done"):
            self._build(self._visible(self._table("base")))

    def _build(self, df: DataFrame) -> None:
        o, path = self.parameters, f"{self.path}/index"
        m = o["pq_m"] or quantize.default_m(o["dim"])
        if o["layout"] == "graph":
            train = quantize.train_opq if o["opq"] else quantize.train_pq
            book = train(df, m, id_col=self.id_col, vec_col=self.vec_col, seed=o["seed"]).rounded()
            graph.build(df, book, o["M"], o["M0"], o["ef_construction"], o["alpha"], o["metric"], o["store_vectors"], seed=o["seed"], id_col=self.id_col, vec_col=self.vec_col).save(path)
        else:
            lists = ivf.list_count(df.count(), o["nlist"])
            centroids = ivf.train_centroids(df, lists, 10, self.id_col, self.vec_col, o["seed"])
            form = quantize.centroid_form(lists)
            centroids = quantize.quantize_centroids(centroids, 8) if form == "int8" else centroids
            rest = df if not o["ivf_residual"] else ivf.residuals(df, centroids, self.id_col, self.vec_col)
            book = quantize.train_pq(rest, m, self.id_col, self.vec_col, seed=o["seed"]).rounded()
            made = ivf.build(df, centroids, book, o["metric"], bool(o["ivf_residual"]), self.id_col, self.vec_col)
            if o["store_vectors"] == "none":
                made.rows = made.rows.withColumn("v", F.lit(None).cast("array<double>"))
            ivf.save(made, path)
        self.spark.createDataFrame([(o["layout"],)], "layout string").coalesce(1).write.mode("overwrite").parquet(f"{path}/done")

    def search(self, queries: DataFrame, k: int = 10, exact: bool = False, **options) -> DataFrame:
        """(qid, rank, id, distance): the index over the base, without what is deleted or replaced, and a
        scan of the delta. ``exact`` scans all live vectors; options are those of the layout's search."""
        o = self.parameters
        if exact or o["layout"] == "exact":
            if o["store_vectors"] == "none":
                raise ValueError("an exact search needs stored vectors")
            return dense.exact_search(self.rows(), queries, k, o["metric"], self.id_col, self.vec_col)
        self.build()
        delta, dead = self._table("delta"), self._table("tombstones")
        gone = dead.select(self.id_col) if dead is not None else None
        if delta is not None:
            gone = delta.select(self.id_col) if gone is None else gone.union(delta.select(self.id_col))
        gone = gone.distinct() if gone is not None else None
        names = {"id_col": self.id_col, "vec_col": self.vec_col}
        if o["layout"] == "graph":
            asked = {"ef": o["ef_search"], "beam": o["beam"], "entry_points": o["entry_points"], "rerank": 0 if o["store_vectors"] == "none" else 2} | options
            found = graph.search(graph.GraphIndex.open(self.spark, f"{self.path}/index"), queries, k, deleted=gone, **asked, **names)
        else:
            index = ivf.load(self.spark, f"{self.path}/index")
            if gone is not None:
                index.rows = index.rows.join(gone.select(F.col(self.id_col).alias("id")), "id", "left_anti").select(*index.rows.columns)
            asked = {"nprobe": o["nprobe"], "rerank_k": o["rerank_k"], "rerank": o["store_vectors"] != "none"} | options
            found = ivf.search(index, queries, k, **asked, **names)
        if delta is None:
            return found
        form = "f16" if o["store_vectors"] == "none" else o["store_vectors"]
        stamped = [self.id_col, self.vec_col]
        fresh = live(delta.select(*stamped).limit(0), delta.select(*stamped, "seq"), dead, self.id_col)
        fresh = quantize.unpacked(fresh, self.vec_col, form, o["dim"])
        return dense.merge_top_k([found, dense.exact_search(fresh, queries, k, o["metric"], self.id_col, self.vec_col)], k)

    def warm(self) -> DataFrame:
        """Load the base into memory; no rows."""
        self._table("base").cache().count()
        return self._table("base").limit(0)


def discover(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, layout, metric, id_col, format_version) of snapshots."""
    rows = []
    for path in paths:
        s = Snapshot.open(spark, path)
        rows.append((path, s.parameters["layout"], s.parameters["metric"], s.id_col, FORMAT_VERSION))
    return spark.createDataFrame(rows, "path string, layout string, metric string, id_col string, format_version int")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(part, n_files, bytes) of a snapshot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"/(base|delta|tombstones|meta|index)/", 1).alias("part")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))
