"""Continuous ingestion into a snapshot: micro-batches of new rows, each id once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..plans.snapshot import Snapshot


def ingest(stream: DataFrame, snapshot: Snapshot, checkpoint: str, trigger: dict | None = None):
    """Append a stream's rows to the delta; ids that are live or repeat are left out.

    Each batch is written under the query's id and its number. A batch that is run again replaces
    what it wrote before, and is compared with all other batches only, so a row arrives once; a
    stream with another checkpoint has another id, and its batches never replace these.
    """
    id_col = snapshot.id_col
    spark = snapshot.spark

    def write(batch: DataFrame, number: int) -> None:
        # the checkpoint keeps the id of the query, whatever restarts it
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        own = f"s-{query}-{number}"
        fresh = batch.dropDuplicates([id_col]).join(snapshot.rows(without=own).select(id_col), id_col, "left_anti")
        rows = snapshot.in_delta(fresh, snapshot._seq())
        rows.write.mode("overwrite").parquet(f"{snapshot.path}/delta/batch={own}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
