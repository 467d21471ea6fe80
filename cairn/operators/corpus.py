"""Corpora and query sets: deterministic shuffles, word windows, samples and known-item queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lexical import hint

MASK = (1 << 64) - 1
#: Ids that one window spans.
SPAN = 4096


class SplitMix64:
    """The generator of that name; its multipliers are fixed values."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
        return z ^ z >> 31

    def uniform(self) -> float:
        return (self.next() >> 11) / 2.0**53


def det_shuffle(items: list, seed: int) -> list:
    """Fisher-Yates from the end on SplitMix64; sequential, so for lists that fit the driver."""
    own, rng = list(items), SplitMix64(seed)
    for last in reversed(range(1, len(own))):
        pick = rng.next() % (last + 1)
        own[last], own[pick] = own[pick], own[last]
    return own


def word_positions(toks: DataFrame) -> DataFrame:
    """(pos, word) of all documents (doc_id, tokens, dl), one after another in order of ids.

    Lengths are added up within spans of ids, and then over one row a span.
    """
    spans = toks.withColumn("span", F.floor(F.col("doc_id") / SPAN))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.groupBy("span").agg(F.sum("dl").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(earlier(Window.orderBy("span"))), F.lit(0))).drop("n")
    within = F.coalesce(F.sum("dl").over(earlier(Window.partitionBy("span").orderBy("doc_id"))), F.lit(0))
    placed = spans.withColumn("before", within).join(starts, "span")
    return placed.select((F.col("start") + F.col("before")).alias("at"), F.posexplode("tokens").alias("k", "word")).select((F.col("at") + F.col("k")).alias("pos"), "word")


def word_windows(words: DataFrame, size: int = 50) -> DataFrame:
    """(doc_id, text): document i has the words at [size i, size i + size) of (pos, word)."""
    rows = words.withColumn("doc_id", F.floor(F.col("pos") / size))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return lists.select("doc_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))


def word_postings(toks: DataFrame) -> DataFrame:
    """(term, df, first_doc, last_doc) of distinct words a document."""
    spread = toks.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
    return spread.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def known_items(toks: DataFrame, n: int, terms: int = 3, seed: str = "known") -> DataFrame:
    """(qid, target, terms): the n documents that md5 puts first, each with the words that md5 puts first."""
    order = F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")))
    targets = toks.select("doc_id", F.array_distinct("tokens").alias("w")).where(F.size("w") >= terms).orderBy(order, "doc_id").limit(n)
    ranked = F.array_sort(F.transform("w", lambda t: F.struct(F.md5(F.concat(F.lit(seed), t)).alias("h"), t.alias("t"))))
    return targets.select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("target"), F.transform(F.slice(ranked, 1, terms), lambda x: x["t"]).alias("terms"))


def documents_with_all(toks: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id) of documents with every term of (qid, terms): matches are counted per document."""
    asked = queries.select("qid", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))
    spread = toks.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
    return spread.join(hint(asked), "term").groupBy("qid", "doc_id", "n_terms").agg(F.count(F.lit(1)).alias("n")).where("n = n_terms").select("qid", "doc_id")


def interleave(rows: DataFrame, kind: str, order: str) -> DataFrame:
    """Round-robin over kinds: rows get ``slot``, their place within their kind by a numeric ``order``.

    Rows are numbered within spans of the order, and spans are added up, so a kind of any size is
    dealt over tasks.
    """
    spans = rows.withColumn("_span", F.floor(F.col(order) / SPAN))
    starts = spans.groupBy(kind, "_span").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy(kind).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = spans.withColumn("_row", F.row_number().over(Window.partitionBy(kind, "_span").orderBy(order)))
    return numbered.join(starts, [kind, "_span"]).withColumn("slot", F.col("_start") + F.col("_row")).drop("_span", "_start", "_row")


def sample_per_kind(rows: DataFrame, kind: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each kind in the order of md5; a smaller n gives a prefix."""
    order = F.md5(F.concat(F.lit(seed), F.col(kind).cast("string"), F.col(key).cast("string")))
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy(kind).orderBy(order, key))).where(F.col("slot") <= n)


def first_per_session(rows: DataFrame, session: str, kind: str, order: str, n: int) -> DataFrame:
    """The first n rows of each kind within each session, by ``order``."""
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy(session, kind).orderBy(order))).where(F.col("slot") <= n)


def plaid_sizing(counts: DataFrame) -> DataFrame:
    """Centroids, sampled documents and lists for (n_docs, n_tokens)."""
    return counts.select(
        "n_docs", "n_tokens",
        F.pow(F.lit(2.0), F.floor(F.log2(16 * F.sqrt("n_tokens")))).cast("long").alias("centroids"),
        F.least(1 + F.floor(16 * F.sqrt(120.0 * F.col("n_docs"))), F.col("n_docs")).alias("sample_docs"),
        F.least(F.floor(4 * F.sqrt("n_docs")), F.col("n_docs")).alias("nlist"),
    )
