"""What the operators share: scratch tables, size-checked broadcasts and worker set-up."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: Rows of narrow key tables (at most ~40 bytes a row) that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def stash(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files survive lost executors, unlike a local checkpoint.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small, else as it is.

    ``df`` should be a stashed narrow table: it is counted here.
    """
    return F.broadcast(df) if df.count() <= rows else df


#: Keys that hold so many rows, and one row in ``HOT_SHARE`` or more, are hot: ``HOT_SHARE`` keys at most.
HOT_LEAST, HOT_SHARE = 1_000, 500


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], least: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``unique``, which has one row a key at most.

    Rows of hot keys stay where they are: what ``unique`` has for them, ``HOT_SHARE`` rows at most,
    is broadcast. The others are exchanged. ``rows`` should be cheap to read again. Up to ``least``
    rows (``HOT_LEAST`` unless given) are few enough for one task, whatever their keys.
    """
    total = rows.count()
    if total < (HOT_LEAST if least is None else least):
        return rows.join(unique, keys, "left")
    hot_rows = max(HOT_LEAST, -(-total // HOT_SHARE))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = stash(counts.where(F.col("_n") >= hot_rows).drop("_n"), "hot")
    if hot.isEmpty():
        return rows.join(unique, keys, "left")
    there = hot.join(unique, keys, "left")
    return rows.join(F.broadcast(there), keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(unique, keys, "left"))


def text_hash(text_col: str) -> Column:
    """What tells apart the texts of rows that share an id."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text hash are in ``gone`` (null matches null)."""
    keys = small(stash(gone.select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "gone"))
    return docs.join(keys, docs[id_col].eqNullSafe(keys["_id"]) & (text_hash(text_col) == keys["_hash"]), "left_anti")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers on any machine import the package: the driver hands out an archive of it, once
    an application."""
    context = spark.sparkContext
    context.environment["TOKENIZERS_PARALLELISM"] = "false"
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    # read by Spark at the driver, which serves it to executors
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
