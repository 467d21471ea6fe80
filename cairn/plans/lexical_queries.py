"""Full-text queries over ``documents`` with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus, lexical
from ..sources import readers
from ..sources.scratch import once

#: (qid, text): frequent, rare, accented, absent and repeated words.
TEXTS = [(1, "thanedble attion"), (2, "Der SCHAU heit"), (3, "éleux que la"), (4, "zzzabsent idiot"), (5, "of of worthless"), (6, "licensed apache license")]
QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "qid long, text string")


def index(spark: SparkSession, d: str) -> lexical.TextIndex:
    """The stored index of the documents, built at its first use."""
    table = f"{d}/documents.parquet"
    return lexical.TextIndex.open(spark, once(spark, "text", table, lambda path: lexical.TextIndex.build(docs(spark, d), path)))


VALUES = ", ".join(f"({q}, '{t}')" for q, t in TEXTS)
TOKS = r"toks AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+') AS t FROM documents), d AS (SELECT doc_id, t, len(t) AS dl FROM toks)"
ASKED = rf"asked(qid, text) AS (VALUES {VALUES}), terms AS (SELECT DISTINCT qid, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+')) AS term FROM asked), nt AS (SELECT qid, count(*) AS n_terms FROM terms GROUP BY qid)"
POST = "p AS (SELECT doc_id, dl, term, count(*) AS f FROM (SELECT doc_id, dl, unnest(t) AS term FROM d) GROUP BY ALL)"
FOUND = "found AS (SELECT qid, doc_id, dl, term, f FROM p JOIN terms USING (term))"
STATS = "stats AS (SELECT count(*) AS n_docs, sum(dl) AS total, sum(dl) / count(*) AS avgdl FROM d), df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"
IDF = "(CASE WHEN ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END)"
BASE = f"WITH {TOKS}, {ASKED}, {POST}, {FOUND}, {STATS}"


def scored(norm: str, having: str = "") -> str:
    return f"(SELECT qid, doc_id, round(sum(-{IDF} * f * 2.2::DOUBLE / (f + {norm})), 6) AS score FROM found JOIN df USING (term) CROSS JOIN stats JOIN nt USING (qid) GROUP BY qid, doc_id, n_terms {having})"


def ranked(source: str, k: int = 10) -> str:
    return f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score, doc_id) AS rank, doc_id, score FROM {source} QUALIFY rank <= {k}"


NORM = "1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * {} / avgdl)"
BM25 = NORM.format("dl")


@register("fts_tokens", f"WITH {TOKS} SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM d")
def fts_tokens(spark, d):
    toks = lexical.tokenized(docs(spark, d))
    return toks.select("doc_id", F.col("dl").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@register("fts_corpus_stats", f"WITH {TOKS} SELECT count(*) AS n_docs, sum(dl)::BIGINT AS total_tokens, round(sum(dl) / count(*), 6) AS avgdl FROM d")
def fts_corpus_stats(spark, d):
    return lexical.corpus_stats(lexical.tokenized(docs(spark, d))).withColumn("avgdl", F.round("avgdl", 6))


@register("fts_df", f"WITH {TOKS} SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM d) GROUP BY term")
def fts_df(spark, d):
    return lexical.document_frequencies(lexical.tokenized(docs(spark, d)))


@register("fts_postings", f"WITH {TOKS} SELECT doc_id, term, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM d) GROUP BY ALL")
def fts_postings(spark, d):
    rows = lexical.postings(lexical.tokenized(docs(spark, d)))
    return rows.select("doc_id", "term", "tf", F.array_min("positions").cast("long").alias("first_pos"), F.array_max("positions").cast("long").alias("last_pos"))


@register("word_postings", f"WITH {TOKS} SELECT term, count(*) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM d) GROUP BY term")
def word_postings(spark, d):
    return corpus.word_postings(lexical.tokenized(docs(spark, d)))


@register("fts_query_terms", rf"SELECT conv_id, turn, array_to_string(list_distinct_ordered, ' ') AS terms FROM (SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM (SELECT conv_id, turn, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+') AS w FROM conversations))")
def fts_query_terms(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.array_join(tx.query_terms(F.col("text")), " ").alias("terms"))


@register("fts_match_and", f"{BASE} SELECT qid, doc_id FROM found JOIN nt USING (qid) GROUP BY qid, doc_id, n_terms HAVING count(*) = n_terms")
def fts_match_and(spark, d):
    return lexical.match_all(index(spark, d), asked(spark))


@register("fts_match_or", f"{BASE} SELECT DISTINCT qid, doc_id FROM found")
def fts_match_or(spark, d):
    return lexical.match_any(index(spark, d), asked(spark))


@register("fts_match_phrase", f"WITH {TOKS} SELECT doc_id, len(list_filter(range(1, len(t)), lambda k: t[k] = 'of' AND t[k + 1] = 'the')) AS n_hits FROM d WHERE n_hits > 0")
def fts_match_phrase(spark, d):
    return lexical.match_phrase(lexical.tokenized(docs(spark, d)), ["of", "the"]).withColumn("n_hits", F.col("n_hits").cast("long"))


@register("fts_match_prefix", f"WITH {TOKS} SELECT doc_id, len(list_filter(t, lambda x: starts_with(x, 'licen'))) AS n_hits FROM d WHERE n_hits > 0")
def fts_match_prefix(spark, d):
    return lexical.match_prefix(lexical.tokenized(docs(spark, d)), "licen").withColumn("n_hits", F.col("n_hits").cast("long"))


def _rows(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


@register("fts_bm25", f"{BASE} {ranked(scored(BM25))}")
def fts_bm25(spark, d):
    return _rows(lexical.search(index(spark, d), asked(spark)))


@register("fts_bm25_and", f"{BASE} {ranked(scored(BM25, 'HAVING count(*) = n_terms'))}")
def fts_bm25_and(spark, d):
    return _rows(lexical.search(index(spark, d), asked(spark), mode="and"))


@register("fts_bm25c", f"{BASE} {ranked(scored('1.2::DOUBLE'))}")
def fts_bm25c(spark, d):
    return _rows(lexical.search(index(spark, d), asked(spark), ranking="bm25c"))


@register("fts_bm25dl", f"{BASE} {ranked(scored(NORM.format('CASE WHEN doc_id % 3 = 0 THEN avgdl ELSE doc_id % 100 END')))}")
def fts_bm25dl(spark, d):
    length = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 100)
    return _rows(lexical.search(index(spark, d), asked(spark), ranking="bm25dl", length=length))


@register("fts_bm25_rerank", f"{BASE}, top AS ({ranked(scored('1.2::DOUBLE'), 50)}), exact AS (SELECT s.* FROM {scored(BM25)} s SEMI JOIN top USING (qid, doc_id)) {ranked('exact')}")
def fts_bm25_rerank(spark, d):
    return _rows(lexical.search(index(spark, d), asked(spark), ranking="bm25-rerank"))


@register("fts_bm25_prefetch", f"{BASE} {ranked(scored(BM25))}")
def fts_bm25_prefetch(spark, d):
    return _rows(lexical.search(index(spark, d), asked(spark), ranking="bm25-prefetch"))


@register("fts_unranked", f"{BASE} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS rank, doc_id, NULL::DOUBLE AS score FROM (SELECT DISTINCT qid, doc_id FROM found) QUALIFY rank <= 10")
def fts_unranked(spark, d):
    return _rows(lexical.search(index(spark, d), asked(spark), ranking="none"))


@register(
    "fts_bm25_weighted",
    rf"""WITH raw AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+') AS a, regexp_extract_all(strip_accents(lower(source)), '[\p{{L}}\p{{N}}]+') AS b FROM documents),
d AS (SELECT doc_id, a, b, len(a) + len(b) AS dl FROM raw),
asked(qid, text) AS (VALUES (1, 'src3 the'), (2, 'src7 idiot')), terms AS (SELECT DISTINCT qid, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS term FROM asked), nt AS (SELECT qid, count(*) AS n_terms FROM terms GROUP BY qid),
p AS (SELECT doc_id, dl, term, sum(w) AS f FROM (SELECT doc_id, dl, unnest(a) AS term, 1::DOUBLE AS w FROM d UNION ALL SELECT doc_id, dl, unnest(b) AS term, 4::DOUBLE AS w FROM d) GROUP BY ALL),
{FOUND}, {STATS} {ranked(scored(BM25))}""",
)
def fts_bm25_weighted(spark, d):
    queries = spark.createDataFrame([(1, "src3 the"), (2, "src7 idiot")], "qid long, text string")
    return _rows(lexical.weighted_search(docs(spark, d), {"text": 1.0, "source": 4.0}, queries))


@register("search_with_text", f"{BASE}, top AS ({ranked(scored('1.2::DOUBLE'), 5)}) SELECT qid, rank, doc_id, score, left(text, 80) AS snippet FROM top JOIN documents USING (doc_id)")
def search_with_text(spark, d):
    hits = lexical.search(index(spark, d), asked(spark), 5, "bm25c")
    return _rows(docs(spark, d).join(lexical.hint(hits), "doc_id").select("qid", "rank", "doc_id", "score", F.left("text", F.lit(80)).alias("snippet")))


@register("fts_stored_length", f"{BASE}, top AS ({ranked(scored('1.2::DOUBLE'), 5)}) SELECT qid, rank, doc_id, dl FROM top LEFT JOIN d USING (doc_id)")
def fts_stored_length(spark, d):
    hits = lexical.search(index(spark, d), asked(spark), 5, "bm25c")
    lengths = lexical.tokenized(docs(spark, d)).select("doc_id", F.col("dl").cast("long").alias("dl"))
    return _rows(hits.join(lengths, "doc_id", "left").select("qid", "rank", "doc_id", "dl"))


KNOWN = f"""WITH {TOKS}, target AS (SELECT doc_id, list_distinct(t) AS w FROM d WHERE len(list_distinct(t)) >= 3 ORDER BY md5('known' || doc_id), doc_id LIMIT 25),
word AS (SELECT doc_id AS qid, unnest(w) AS term FROM target), three AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY md5('known' || term), term) AS k FROM word QUALIFY k <= 3)"""


@register("known_items", f"{KNOWN} SELECT qid, qid AS target, string_agg(term, ' ' ORDER BY k) AS terms FROM three GROUP BY qid")
def known_items(spark, d):
    return corpus.known_items(lexical.tokenized(docs(spark, d)), 25).withColumn("terms", F.array_join("terms", " "))


@register("known_item_truth", f"{KNOWN} SELECT qid, doc_id FROM three JOIN (SELECT DISTINCT doc_id, unnest(t) AS term FROM d) USING (term) GROUP BY qid, doc_id HAVING count(*) = 3")
def known_item_truth(spark, d):
    toks = lexical.tokenized(docs(spark, d))
    return corpus.documents_with_all(toks, corpus.known_items(toks, 25))


@register("first_words", r"SELECT doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1, 50), ' ') AS body FROM documents")
def first_words(spark, d):
    return docs(spark, d).select("doc_id", tx.first_words(F.col("text")).alias("body"))


_P = r"regexp_replace({}, '^\s*(search(\s+engine)?(\s+query)?|query)\s*[:\-]?\s*', '', 'i')"
_Q = "trim(trim({}), '\"“”''` ')"
_STEP = lambda x: _Q.format(_P.format(x))


@register("clean_query", f"SELECT conv_id, turn, {_STEP(_STEP(r'''trim(split_part(trim('Search query: ' || text), chr(10), 1))'''))} AS query FROM conversations")
def clean_query(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return rows.select("conv_id", "turn", tx.clean_query(F.concat(F.lit("Search query: "), F.col("text"))).alias("query"))


@register("contains_word", "SELECT doc_id, contains(lower(text), lower(source)) AS has_source, contains(lower(text), 'apache') AS has_word FROM documents")
def contains_word(spark, d):
    return docs(spark, d).select("doc_id", tx.contains_word(F.col("text"), F.col("source")).alias("has_source"), tx.contains_word(F.col("text"), F.lit("APACHE")).alias("has_word"))


@register("skip_tokens", f"WITH {TOKS} SELECT doc_id, len(list_filter(list_transform(t, lambda x: len(x)), lambda n: n NOT IN (2, 5))) AS n_left FROM d")
def skip_tokens(spark, d):
    toks = lexical.tokenized(docs(spark, d))
    return toks.select("doc_id", F.size(tx.skip_tokens(F.transform("tokens", F.length), [2, 5])).cast("long").alias("n_left"))


@register("word_windows", f"WITH {TOKS}, w AS (SELECT t AS words, sum(len(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d), p AS (SELECT unnest(words) AS word, coalesce(before, 0) + generate_subscripts(words, 1) - 1 AS pos FROM w) SELECT (pos // 50)::BIGINT AS doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM p GROUP BY 1")
def word_windows(spark, d):
    return corpus.word_windows(corpus.word_positions(lexical.tokenized(docs(spark, d))))


@register("read_corpus", r"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, body FROM (SELECT doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1, 50), ' ') AS body FROM documents) WHERE trim(body) <> ''")
def read_corpus(spark, d):
    """Documents written as a line each, in order, and read again."""
    def write(path: str) -> None:
        docs(spark, d).orderBy("doc_id").select(tx.first_words(F.col("text")).alias("value")).where("value IS NOT NULL").write.mode("overwrite").text(path)

    return readers.read_corpus(spark, once(spark, "corpus", f"{d}/documents.parquet", write))
