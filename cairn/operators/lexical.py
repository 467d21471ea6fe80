"""Full-text search: postings, boolean and phrase matches, BM25 and its variants.

Searches read a stored index: postings sorted by term, document frequencies and corpus statistics.
A search names its terms, so the scan skips the files and row groups of all others, and what is
exchanged grows with the matches. Without an index, documents are tokenised and cut to the terms
asked for first. Query batches are broadcast after one count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import query_terms, tokens

K1, B = 1.2, 0.75
#: Rows of a query table that are broadcast; a larger one is joined by exchange.
MAX_BROADCAST_QUERIES = 100_000
#: Terms that a filter names one by one.
MAX_NAMED_TERMS = 1000


def hint(small: DataFrame, rows: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Broadcast ``small`` if a count bounded by ``rows`` says that it is small."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def tokenized(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, tokens, dl)."""
    cut = docs.select(F.col(id_col).alias("doc_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    return cut.withColumn("dl", F.size("tokens"))


def postings(toks: DataFrame) -> DataFrame:
    """(doc_id, term, tf, positions)."""
    spread = toks.select("doc_id", F.posexplode("tokens").alias("pos", "term"))
    return spread.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def document_frequencies(toks: DataFrame) -> DataFrame:
    return toks.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(toks: DataFrame) -> DataFrame:
    """One row: n_docs, total_tokens, avgdl (1 without documents)."""
    s = toks.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"))
    return s.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total_tokens") / F.col("n_docs")).otherwise(F.lit(1.0)))


def terms_of(queries: DataFrame) -> DataFrame:
    """(qid, term, n_terms) of queries (qid, text), each term once."""
    cut = queries.select("qid", query_terms(F.col("text")).alias("terms"))
    return cut.select("qid", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


@dataclass(frozen=True)
class TextIndex:
    """postings (term, doc_id, f, dl) and terms (term, df), both sorted by term, and stats (one row)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> "TextIndex":
        """Tokenise once and write. Postings are ranged by term and document, so the list of a frequent
        term is dealt over files."""
        toks = tokenized(docs, text_col, id_col)
        spread = toks.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("f"))
        write = lambda df: df.write.mode("overwrite").option("parquet.block.size", 16 << 20)
        write(spread.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")).parquet(f"{path}/postings")
        postings = docs.sparkSession.read.parquet(f"{path}/postings")
        counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        write(counted.repartitionByRange("term").sortWithinPartitions("term")).parquet(f"{path}/terms")
        write(corpus_stats(toks).coalesce(1)).parquet(f"{path}/stats")
        return cls.open(docs.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "TextIndex":
        return cls(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "stats")))


@dataclass(frozen=True)
class Asked:
    """The terms of a query batch (qid, term, n_terms), counted once.

    ``rows`` counts them up to ``MAX_BROADCAST_QUERIES`` + 1, ``names`` are the distinct ones while they are few.
    """

    terms: DataFrame
    rows: int
    names: list[str] | None

    @classmethod
    def of(cls, queries: DataFrame) -> "Asked":
        terms = terms_of(queries)
        first = [r[0] for r in terms.select("term").limit(MAX_NAMED_TERMS + 1).collect()]
        rows = len(first) if len(first) <= MAX_NAMED_TERMS else terms.limit(MAX_BROADCAST_QUERIES + 1).count()
        return cls(terms, rows, sorted(set(first)) if len(first) <= MAX_NAMED_TERMS else None)

    def hint(self, df: DataFrame, each: int = 1) -> DataFrame:
        """Broadcast ``df``, which has at most ``each`` rows a term asked for, if these are few."""
        return F.broadcast(df) if self.rows * each <= MAX_BROADCAST_QUERIES else df

    def only(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` with a term that is asked for; few terms are named in the scan's filter."""
        if self.names is not None:
            return df.where(F.col("term").isin(self.names))
        return df.join(self.hint(self.terms.select("term").distinct()), "term", "left_semi")


def matches(toks: DataFrame | TextIndex, queries: DataFrame | Asked) -> DataFrame:
    """(qid, doc_id, dl, term, n_terms, f): how often each query term occurs in each document."""
    asked = queries if isinstance(queries, Asked) else Asked.of(queries)
    if isinstance(toks, TextIndex):
        found = asked.only(toks.postings).select("doc_id", "dl", "term", "f")
    else:
        found = asked.only(toks.select("doc_id", "dl", F.explode("tokens").alias("term"))).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("f"))
    return found.join(asked.hint(asked.terms), "term")


def match_all(toks: DataFrame | TextIndex, queries: DataFrame | Asked) -> DataFrame:
    """(qid, doc_id) of documents that have every term."""
    return matches(toks, queries).groupBy("qid", "doc_id", "n_terms").agg(F.count(F.lit(1)).alias("n")).where("n = n_terms").select("qid", "doc_id")


def match_any(toks: DataFrame | TextIndex, queries: DataFrame | Asked) -> DataFrame:
    return matches(toks, queries).select("qid", "doc_id").distinct()


def match_phrase(toks: DataFrame, phrase: list[str]) -> DataFrame:
    """(doc_id, n_hits): where the terms follow one another."""
    n = len(phrase)
    wanted = F.array(*[F.lit(p) for p in phrase])

    def hits(t: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda k: F.slice(t, k, n) == wanted))

    # bound to a variable, the tokens are cut once a row
    counted = toks.where(F.array_contains("tokens", phrase[0])).select("doc_id", F.transform(F.array("tokens"), hits)[0].alias("n_hits"))
    return counted.where("n_hits > 0")


def match_prefix(toks: DataFrame, prefix: str) -> DataFrame:
    """(doc_id, n_hits): tokens that start so."""
    return toks.select("doc_id", F.size(F.filter("tokens", lambda t: F.startswith(t, F.lit(prefix)))).alias("n_hits")).where("n_hits > 0")


def rank(scored: DataFrame, k: int, by: list[Column], name: str = "rank") -> DataFrame:
    """The first k rows of each qid, numbered from 1."""
    numbered = scored.withColumn(name, F.row_number().over(Window.partitionBy("qid").orderBy(*by)))
    return numbered.where(F.col(name) <= k)


def score(found: DataFrame, stats: DataFrame, frequencies: DataFrame, norm: str = "bm25", mode: str = "or", length: Column | None = None, asked: Asked | None = None) -> DataFrame:
    """(qid, doc_id, score), lower is better. ``frequencies`` (term, df) has the terms of ``asked``.

    ``norm``: "bm25" (own length), "bm25c" (every document of average length) or "bm25dl" (the
    length in ``length``, the average where null). ``mode`` "and" keeps documents with all terms.
    """
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    if norm == "bm25c":
        weight = F.lit(K1)
    elif norm in ("bm25", "bm25dl"):
        own = F.col("dl") if norm == "bm25" else F.coalesce(length, F.col("avgdl"))
        weight = K1 * (1 - B + B * own / F.col("avgdl"))
    else:
        raise ValueError(f"unknown ranking {norm}")
    f = F.col("f")
    # one row of statistics
    joined = found.join(asked.hint(frequencies) if asked else frequencies, "term").join(F.broadcast(stats))
    summed = joined.groupBy("qid", "doc_id", "n_terms").agg(F.count(F.lit(1)).alias("n"), F.sum(-idf * f * (K1 + 1) / (f + weight)).alias("score"))
    if mode == "and":
        summed = summed.where("n = n_terms")
    return summed.select("qid", "doc_id", F.round("score", 6).alias("score"))


def search(docs: DataFrame | TextIndex, queries: DataFrame, k: int = 10, ranking: str = "bm25", mode: str = "or", depth: int = 50, length: Column | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(qid, rank, doc_id, score) of the best k documents of each query (qid, text).

    Searched are documents or their index. Rankings: bm25, bm25c, bm25dl, bm25-prefetch (bm25),
    bm25-rerank (bm25 of the best max(``depth``, k) by bm25c), none (order of ids, no score). Ties
    go to the smaller id.
    """
    if k < 1:
        return queries.sparkSession.createDataFrame([], "qid long, rank int, doc_id long, score double")
    index = docs if isinstance(docs, TextIndex) else tokenized(docs, text_col, id_col)
    asked = Asked.of(queries)
    order = [F.col("score"), F.col("doc_id")]
    if ranking == "none":
        hits = match_all(index, asked) if mode == "and" else match_any(index, asked)
        return rank(hits.withColumn("score", F.lit(None).cast("double")), k, [F.col("doc_id")]).select("qid", "rank", "doc_id", "score")
    found = matches(index, asked)
    if isinstance(index, TextIndex):
        stats, frequencies = index.stats, asked.only(index.terms)
    else:
        stats = corpus_stats(index)
        frequencies = asked.only(index.select(F.explode(F.array_distinct("tokens")).alias("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if ranking == "bm25-rerank":
        most = max(depth, k)
        first = rank(score(found, stats, frequencies, "bm25c", mode, asked=asked), most, order).select("qid", "doc_id")
        exact = score(found.join(asked.hint(first, most), ["qid", "doc_id"], "left_semi"), stats, frequencies, "bm25", mode, asked=asked)
        return rank(exact, k, order).select("qid", "rank", "doc_id", "score")
    norm = "bm25" if ranking == "bm25-prefetch" else ranking
    return rank(score(found, stats, frequencies, norm, mode, length, asked), k, order).select("qid", "rank", "doc_id", "score")


def weighted_search(docs: DataFrame, columns: dict[str, float], queries: DataFrame, k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """bm25 over several text columns, whose hits count with the columns' weights."""
    cut = docs.select(F.col(id_col).alias("doc_id"), *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"t{n}") for n, c in enumerate(columns)])
    toks = cut.withColumn("tokens", F.concat(*[f"t{n}" for n in range(len(columns))])).withColumn("dl", F.size("tokens"))
    asked = Asked.of(queries)
    parts = [toks.select("doc_id", "dl", F.explode(f"t{n}").alias("term"), F.lit(float(w)).alias("w")) for n, w in enumerate(columns.values())]
    spread = parts[0]
    for part in parts[1:]:
        spread = spread.unionByName(part)
    found = asked.only(spread).groupBy("doc_id", "dl", "term").agg(F.sum("w").alias("f")).join(asked.hint(asked.terms), "term")
    frequencies = asked.only(toks.select(F.explode(F.array_distinct("tokens")).alias("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return rank(score(found, corpus_stats(toks), frequencies, asked=asked), k, [F.col("score"), F.col("doc_id")]).select("qid", "rank", "doc_id", "score")
