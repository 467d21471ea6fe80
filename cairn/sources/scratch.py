"""The folder that driver and executors share: scratch tables, and indexes that are built once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Only a session within one machine may do without."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/cairn"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}/{name}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the files of a table: another version of it has another string."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return ";".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in (fs.listStatus(p) if fs.exists(p) else ())))


_made: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, name: str, table: str, make: Callable[[str], object]) -> str:
    """The folder of an index over ``table``, which ``make(folder)`` writes the first time.

    A later call of the same application finds it, unless the table has changed.
    """
    key = (spark.sparkContext.applicationId, name, f"{table} {version(spark, table)}")
    if key not in _made:
        path = scratch_path(spark, name)
        make(path)
        _made[key] = path
    return _made[key]
