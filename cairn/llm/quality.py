"""Quality rules: base counts of every text, and a log-likelihood ratio of hashed word n-grams.

Two multinomials over hashed one- and two-word n-grams are counted: one over trusted target rows
(those labelled as of good quality), one over the whole raw corpus. A text's score is the mean over
its n-grams of the log ratio of their chances under the two. A fixed threshold decides.

Both counts are kept as arrays of a fixed number of buckets and added up per task, so little more
than the buckets is exchanged. If the trusted ids are too many to broadcast, their bitmap is, and
only the texts that pass it are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ship, stash
from .exact_dedup import build_filter, filter_bits, through_filter

#: Hash buckets of the multinomials.
BUCKETS = 1 << 14
#: Texts whose mean log ratio is below this go. Fitted on half of the rows that are labelled good, the
#: lowest score of the other half was -0.07 (of 1,628) and -0.10 (of 8,766) on two corpora, and
#: a fixed value below both keeps such rows the same in every run; see ``threshold_for``.
THRESHOLD = -0.12
SYMBOLS = b"#*$%&|<>"
#: Words whose hashes a worker remembers at most.
MEMO_WORDS = 400_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word.lower())
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def ngram_buckets(words: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all one- and two-word n-grams, with A-Z in lower case."""
    if len(_hashes) > MEMO_WORDS:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pair ^= pair >> np.uint64(31)
    return (np.concatenate([h, pair * np.uint64(0xD6E8FEB86659FD93)]) >> np.uint64(40)).astype(np.int64) & (buckets - 1)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in windows of ``width`` words that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    number = dict(zip(words, range(n), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    key, bound = ids, n
    for k in range(1, width):
        if bound * n >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            bound = n
        key, bound = key[:-1] * n + ids[k:], bound * n
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[:-width] += again
    edge[width:] -= again
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words between ASCII white space, then word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return words, len(b"".join(words).decode()), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def fit_ratio(docs: DataFrame, trusted: DataFrame, text_col: str = "text", id_col: str = "doc_id", buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of each bucket's chance, target over raw, with add-one smoothing.

    ``trusted`` has the ids of target rows. Every row of ``docs`` counts as raw, and every trusted
    row as target too. Without a trusted row all ratios are 0.
    """
    ship(docs.sparkSession)
    ids = stash(trusted.select(F.col(id_col).cast("long").alias("_id")).where("_id IS NOT NULL").distinct(), "trusted")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    n_ids = ids.count()
    if n_ids <= BROADCAST_ROWS:
        marked = rows.join(F.broadcast(ids.withColumn("_hit", F.lit(True))), "_id", "left")
        parts = [marked.select("_text", F.lit(True).alias("raw"), F.coalesce("_hit", F.lit(False)).alias("target"))]
    else:
        bits = filter_bits(n_ids)
        key = F.xxhash64("_id").alias("mark")
        passed = through_filter(rows.select("*", key), build_filter(ids.select(key), bits), bits)
        hits = passed.join(ids, "_id", "left_semi")
        parts = [rows.select("_text", F.lit(True).alias("raw"), F.lit(False).alias("target")), hits.select("_text", F.lit(False).alias("raw"), F.lit(True).alias("target"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, is_raw, hit in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                if words:
                    own = np.bincount(ngram_buckets(words, buckets), minlength=buckets)
                    if is_raw:
                        raw += own
                    if hit:
                        target += own
        full = np.flatnonzero(raw + target)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(raw[full]), pa.array(target[full])], ["bucket", "raw", "target"])

    partial = [p.mapInArrow(run, "bucket long, raw long, target long") for p in parts]
    every = partial[0] if len(partial) == 1 else partial[0].unionByName(partial[1])
    counted = every.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in counted.collect():  # at most one row a bucket
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def threshold_for(scored: DataFrame, trusted: DataFrame, share: float = 0.999, id_col: str = "doc_id") -> float:
    """The score that this share of the trusted rows reaches, of those that pass the base rules; for a
    corpus of another kind. Without such rows it is ``THRESHOLD``."""
    kept = scored.where("NOT base_failed").join(trusted.select(id_col).distinct(), id_col, "left_semi")
    found = kept.agg(F.percentile_approx("score", 1 - share, 100_000)).first()[0]
    return THRESHOLD if found is None else float(found)


def quality_rules(docs: DataFrame, trusted: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``score`` (mean log ratio; 0 without words) and ``kept``.

    A row fails the base rules with fewer than 10 words or with more than a fifth of its words in
    repeated five-word windows. Of the others those of a score of at least ``threshold`` are kept.
    Null counts as a text without words. Texts are read whole; repeated rows get equal rows, null
    ids are carried, other columns are ignored, an empty table stays empty.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit_ratio(docs, trusted, text_col, id_col))
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for value in batch.column(1):
                words, chars, symbols, lines, repeated = base_counts(value.as_py() or b"")
                n = len(words)
                failed = n < 10 or 100 * repeated > 20 * n
                score = float(ratio[ngram_buckets(words, len(ratio))].mean()) if words else 0.0
                for column, x in zip(out, (n, chars, symbols, lines, repeated, failed, score, not failed and score >= threshold), strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op1_quality_ratio(spark, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted)
