"""Exact deduplication by a log-structured merge index of text digests (DataFrame operations only).

Texts are fingerprinted in one scan. Fingerprints fill memtables, and each memtable is flushed as a
run: a table bucketed and sorted by digest, with a bitmap filter of its digests. All runs have the
same buckets, so compaction merges two runs bucket by bucket, in order and without an exchange, and
keeps each digest's count and the identifier that survives. A lookup passes the runs' filters
before it reads a run.

A digest met twice is only a *hit*: the rows that pass the hits' filter are read again and their
whole texts compared, byte by byte, as grouping keys. Copies collapse before each exchange, so a
text that holds a third of all rows moves once per task.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_rows, scratch_path, stash, text_hash

#: Bits that one bitmap of the bitmap functions has.
BITMAP_BITS = 32768
KEYS = ("digest", "mark", "size")
COLUMNS = (*KEYS, "n", "keep")


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def fingerprints(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, digest binary, mark long, size int) of every row."""
    t = _text(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"),
        F.xxhash64(t).alias("mark"),
        F.octet_length(t).alias("size"),
    )


def _position(bits: int) -> Column:
    return F.pmod(F.col("mark"), F.lit(bits)) + 1


def build_filter(entries: DataFrame, bits: int) -> DataFrame:
    """Bitmap of the marks in ``entries``: rows (bucket, bitmap), ``bits`` / 8 bytes in all."""
    p = _position(bits)
    return entries.groupBy(F.bitmap_bucket_number(p).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bitmap")
    )


def through_filter(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Rows whose mark's bit is set; ``bitmaps`` has at most ``MAX_FILTER_BITS`` / 8 bytes."""
    p = _position(bits)
    bit = F.bitmap_bit_position(p)
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(p)).join(F.broadcast(bitmaps), "bucket")
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.where(_bit_set(byte, bit)).drop("bucket", "bitmap")


def _bit_set(byte: Column, bit: Column) -> Column:
    return F.call_function("getbit", byte.cast("long"), (bit % 8).cast("int")) == 1


#: A filter never exceeds 64 MB, which 32 million keys fill; past that it lets more rows through, and stays right.
MAX_FILTER_BITS = 1 << 29
#: Rows of a memtable, at least, and how many memtables there are at most: beyond their product they grow.
MEMTABLE_ROWS, MAX_MEMTABLES = 100_000, 8
#: Rows of a bucket, about.
BUCKET_ROWS, MAX_BUCKETS = 1_000_000, 20_000


def filter_bits(n: int) -> int:
    """Sixteen bits a key, in whole bitmaps."""
    return min(MAX_FILTER_BITS, BITMAP_BITS * max(1, -(-16 * n // BITMAP_BITS)))


@dataclass
class Run:
    """A table (digest, mark, size, n, keep) bucketed and sorted by digest, and its filter."""

    rows: DataFrame
    n_rows: int
    bits: int
    bitmaps: DataFrame


@dataclass
class DigestIndex:
    """Runs of one bucketing, oldest first. ``keep`` is "min" or "max"."""

    buckets: int
    keep: str = "min"
    runs: tuple[Run, ...] = ()

    def _written(self, rows: DataFrame) -> Run:
        """Write rows that are dealt by buckets as a run, with its filter."""
        spark = rows.sparkSession
        name = f"cairn_run_{uuid.uuid4().hex}"
        rows.select(*COLUMNS).write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", scratch_path(spark, "run")).format("parquet").saveAsTable(name)
        table = spark.table(name)
        n = table.count()
        bits = filter_bits(n)
        return Run(table, n, bits, stash(build_filter(table, bits), "filter"))

    def flush(self, entries: DataFrame) -> "DigestIndex":
        """The index with a memtable of entries (id, digest, mark, size) as a further run."""
        pick = F.max if self.keep == "max" else F.min
        # copies collapse here, before their digest decides on a bucket
        folded = entries.groupBy("digest").agg(F.first("mark").alias("mark"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n"), pick("id").alias("keep"))
        return DigestIndex(self.buckets, self.keep, (*self.runs, self._written(folded.repartition(self.buckets, "digest"))))

    def compact(self) -> "DigestIndex":
        """The index with all runs merged into one; neighbours are merged first."""
        runs = list(self.runs)
        while len(runs) > 1:
            runs = [self._merge(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        return DigestIndex(self.buckets, self.keep, tuple(runs))

    def _merge(self, old: Run, new: Run) -> Run:
        a, b = (r.rows.select("digest", *(F.col(c).alias(f"{c}_{k}") for c in COLUMNS[1:])) for k, r in enumerate((old, new)))
        both = a.hint("merge").join(b, "digest", "full")
        pick = F.greatest if self.keep == "max" else F.least
        return self._written(
            both.select(
                "digest", F.coalesce("mark_0", "mark_1").alias("mark"), F.coalesce("size_0", "size_1").alias("size"),
                (F.coalesce("n_0", F.lit(0)) + F.coalesce("n_1", F.lit(0))).alias("n"), pick("keep_0", "keep_1").alias("keep"),
            )
        )

    def lookup(self, entries: DataFrame) -> DataFrame:
        """Entries found in the index, with the identifier kept there; absent ones stop at the filters."""
        pick = F.max if self.keep == "max" else F.min
        found = [through_filter(entries, r.bitmaps, r.bits).join(r.rows.select("digest", "keep"), "digest") for r in self.runs]
        if not found:
            return entries.limit(0).withColumn("keep", F.col("id"))
        every = found[0]
        for part in found[1:]:
            every = every.unionByName(part)
        return every.groupBy("id", *KEYS).agg(pick("keep").alias("keep"))

    @property
    def base(self) -> DataFrame:
        """The rows of the only run."""
        (run,) = self.runs
        return run.rows


def build_index(entries: DataFrame, keep: str = "min", memtable_rows: int = MEMTABLE_ROWS) -> DigestIndex:
    """Deal stashed entries over memtables, flush each as a run and compact the runs."""
    total = entries.count()
    memtables = max(1, min(MAX_MEMTABLES, -(-total // memtable_rows)))
    index = DigestIndex(max(1, min(MAX_BUCKETS, total // BUCKET_ROWS + entries.sparkSession.sparkContext.defaultParallelism)), keep)
    for k in range(memtables):
        index = index.flush(entries.where(F.pmod(F.xxhash64("id", "digest"), F.lit(memtables)) == k))
    return index.compact()


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "min", memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and
    ``text_hash`` (see ``common.text_hash``).

    Rows are copies when their texts have the same bytes; null counts as the empty text, and all
    empty texts are copies of one another. Of a group, the row with the smallest identifier stays
    (``keep="max"``: the largest). Rows that repeat an identifier and its text all get the same
    verdict; a null identifier never beats another one, and stays only among null identifiers.
    Other columns are neither read nor returned. An empty table gives an empty table. Two texts
    of one SHA-256 digest stop the job with an error instead of merging.
    """
    entries = stash(fingerprints(docs, text_col, id_col), "fingerprints")
    index = build_index(entries, keep, memtable_rows)
    hits = index.base.where("n > 1")
    n_hits = hits.count()
    bits = filter_bits(n_hits)
    t = _text(F.col(text_col))
    again = docs.select(F.xxhash64(t).alias("mark"), t.alias("_text"))
    compared = (
        through_filter(again, build_filter(hits, bits), bits)
        .groupBy("mark", "_text")
        .agg(F.count(F.lit(1)).alias("n_same"))
        .select(F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"), "mark", F.octet_length("_text").alias("size"), "n_same")
        .groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_same").alias("n_rows"))
    )
    groups = stash(
        hits.join(compared, list(KEYS), "left").select(
            *KEYS,
            "keep",
            F.when((F.col("n_texts") == 1) & (F.col("n_rows") == F.col("n")), F.col("n"))
            .otherwise(F.raise_error(F.lit("texts of one digest differ")).cast("long"))
            .alias("n"),
        ),
        "groups",
    )
    joined = entries.join(F.broadcast(groups) if n_hits <= 200_000 else groups, list(KEYS), "left")
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("mark").alias("text_hash"),
    )


def drop_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "min") -> DataFrame:
    """``docs`` with one row of each group of copies, all columns as they were.

    Rows that repeat an id and its text count as copies too: one of them stays.
    """
    decided = stash(exact_dedup(docs, text_col, id_col, keep), "decided")
    left = drop_rows(docs, decided.where("NOT kept"), id_col, text_col)
    again = decided.where("kept AND group_size > 1").groupBy(id_col, "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if again.isEmpty():
        return left
    single = drop_rows(left, again, id_col, text_col)
    keys = again.select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"))
    repeated = left.join(keys, left[id_col].eqNullSafe(keys["_id"]) & (text_hash(text_col) == keys["_hash"]), "left_semi")
    return single.unionByName(repeated.dropDuplicates([id_col, text_col]))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max").drop("text_hash")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
