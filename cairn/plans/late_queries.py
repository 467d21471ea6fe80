"""Late-interaction queries with their SQL.

Ten consecutive vectors of ``embeddings`` make a document of ten tokens; four tokens of some
documents make a query; label means are the centroids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import corpus, late, quantize
from ..sources.scratch import once

QUERIES: dict = {}
SQL: dict = {}
PROBES, DOCS, STOP, FLOOR = 2, 8, 0.5, 40


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def tokens(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.floor(F.col("vec_id") / 10).alias("doc_id"), (F.col("vec_id") % 10).alias("pos"), vx.doubles("embedding").alias("v"))


def asked(spark, d) -> DataFrame:
    rows = tokens(spark, d).where((F.col("doc_id") % 50 == 0) & F.col("pos").between(2, 5))
    return rows.select(F.col("doc_id").alias("qid"), (F.col("pos") - 2).alias("i"), F.col("v").alias("q"))


def centroids(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    means = e.select("label", F.posexplode(vx.doubles("embedding")).alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    lists = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("c"))
    return lists.select(F.col("label").alias("cid"), F.transform("c", lambda p: p["x"]).alias("c"))


def out(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


T = f"""tok AS (SELECT vec_id // 10 AS doc_id, vec_id % 10 AS pos, embedding::DOUBLE[] AS v, label FROM embeddings),
q AS (SELECT doc_id AS qid, pos - 2 AS i, v AS qv FROM tok WHERE doc_id % 50 = 0 AND pos BETWEEN 2 AND 5)"""
CEN = """cen AS (SELECT label AS cid, list(x ORDER BY d) AS c FROM (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS d, unnest(v) AS x FROM tok) GROUP BY ALL) GROUP BY label)"""
OWN = "own AS (SELECT doc_id, pos, v, cid, c FROM (SELECT doc_id, pos, v, cid, c, row_number() OVER (PARTITION BY doc_id, pos ORDER BY list_dot_product(v, c) DESC, cid) AS n FROM tok, cen) WHERE n = 1)"
RES = "res AS (SELECT doc_id, pos, cid, c, list_transform(list_zip(v, c), lambda x: x[1] - x[2]) AS r FROM own)"
CODEC = """val AS (SELECT unnest(r) AS x FROM res), cod AS (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS cut, quantile_cont(x, [0.125, 0.375, 0.625, 0.875]) AS wgt FROM val)"""
DEC = """buk AS (SELECT doc_id, pos, cid, c, list_transform(r, lambda y: len(list_filter(cut, lambda z: z < y))) AS b, wgt FROM res, cod),
raw AS (SELECT doc_id, pos, cid, list_transform(list_zip(c, b), lambda x: x[1] + wgt[x[2]::INT + 1]) AS w FROM buk),
dec AS (SELECT doc_id, pos, cid, list_transform(w, lambda y: y / greatest(sqrt(list_dot_product(w, w)), 1e-12)) AS vh FROM raw)"""
S = "s AS (SELECT qid, i, cid, list_dot_product(qv, c) AS s FROM q, cen)"
PROBE = f"pr0 AS (SELECT *, row_number() OVER (PARTITION BY qid, i ORDER BY s DESC, cid) AS n FROM s QUALIFY n <= {PROBES}), pr AS (SELECT *, min(s) OVER (PARTITION BY qid, i) AS impute, max(s) OVER (PARTITION BY qid, i) AS top, false AS stopped FROM pr0)"
HEAD = f"WITH {T}, {CEN}, {OWN}, {RES}, {CODEC}, {DEC}, {S}, {PROBE}"


def ranked(source: str, k: int) -> str:
    return f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM {source} QUALIFY rank <= {k}"


def best(rows: str) -> str:
    return f"(SELECT qid, doc_id, round(sum(m), 6) AS score FROM (SELECT qid, doc_id, i, max(x) AS m FROM {rows} GROUP BY ALL) GROUP BY ALL)"


@register("maxsim_exact", f"WITH {T} {ranked(best('(SELECT qid, doc_id, i, list_dot_product(qv, v) AS x FROM q, tok)'), 5)}")
def maxsim_exact(spark, d):
    return out(late.maxsim(tokens(spark, d), asked(spark, d), 5))


@register("late_assign", f"WITH {T}, {CEN}, {OWN} SELECT doc_id, pos, cid FROM own")
def late_assign(spark, d):
    return late.assign(tokens(spark, d), centroids(spark, d)).select("doc_id", "pos", F.col("cid").cast("int").alias("cid"))


def rest(spark, d) -> DataFrame:
    return late.residuals(late.assign(tokens(spark, d), centroids(spark, d)), centroids(spark, d))


@register("late_codec_train", f"WITH {T}, {CEN}, {OWN}, {RES}, {CODEC} SELECT kind, n, round(x, 6) AS x FROM (SELECT 'cutoff' AS kind, unnest(range(3)) AS n, unnest(cut) AS x FROM cod UNION ALL SELECT 'weight', unnest(range(4)), unnest(wgt) FROM cod UNION ALL SELECT 'threshold', 0, quantile_cont(sqrt(list_dot_product(r, r)), 0.75) FROM res)")
def late_codec_train(spark, d):
    row = late.codec_table(rest(spark, d))
    parts = [row.select(F.lit(kind).alias("kind"), F.posexplode(c).alias("n", "x")) for kind, c in (("cutoff", "cutoffs"), ("weight", "weights"))]
    parts.append(row.select(F.lit("threshold").alias("kind"), F.lit(0).alias("n"), F.col("threshold").alias("x")))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.select("kind", F.col("n").cast("long").alias("n"), F.round("x", 6).alias("x"))


@register("residual_bucketize", f"WITH {T}, {CEN}, {OWN}, {RES}, {CODEC}, {DEC} SELECT doc_id, pos, array_to_string(b, '') AS buckets FROM buk")
def residual_bucketize(spark, d):
    r = rest(spark, d)
    return late.encode(r, late.train_codec(r)).select("doc_id", "pos", F.array_join(F.transform("res", lambda b: b.cast("string")), "").alias("buckets"))


def stored(spark, d) -> tuple[DataFrame, DataFrame]:
    """Coded tokens and centroids, built at their first use."""
    path = once(spark, "late", f"{d}/embeddings.parquet", lambda path: late.save(tokens(spark, d), centroids(spark, d), path))
    return late.load(spark, path)


def coded(spark, d) -> DataFrame:
    return stored(spark, d)[0]


@register("residual_decode", f"WITH {T}, {CEN}, {OWN}, {RES}, {CODEC}, {DEC} SELECT doc_id, pos, unnest(range(64)) AS d, round(unnest(vh), 6) + 0 AS x FROM dec")
def residual_decode(spark, d):
    rows = coded(spark, d).select("doc_id", "pos", F.posexplode("v_hat").alias("d", "x"))
    return rows.select("doc_id", "pos", F.col("d").cast("long").alias("d"), (F.round("x", 6) + 0.0).alias("x"))


@register("late_exact", f"{HEAD} {ranked(best('(SELECT qid, doc_id, i, list_dot_product(qv, vh) AS x FROM q, dec)'), 5)}")
def late_exact(spark, d):
    return out(late.maxsim(coded(spark, d), asked(spark, d), 5, "v_hat"))


@register("late_ivf", f"{HEAD} SELECT DISTINCT cid, doc_id FROM dec")
def late_ivf(spark, d):
    return late.inverted_lists(coded(spark, d)).select(F.col("cid").cast("int").alias("cid"), "doc_id")


@register("late_postings", f"{HEAD} SELECT cid, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs FROM dec GROUP BY cid")
def late_postings(spark, d):
    rows = coded(spark, d)
    both = late.list_lengths(rows).withColumnRenamed("n_list", "n_tokens").join(late.list_lengths(rows, "plaid").withColumnRenamed("n_list", "n_docs"), "cid")
    return both.select(F.col("cid").cast("int").alias("cid"), "n_tokens", "n_docs")


@register("late_probe", f"WITH {T}, {CEN}, {S}, {PROBE} SELECT qid, i, cid, round(s, 6) AS s, n AS probe_rank, round(impute, 6) AS impute FROM pr")
def late_probe(spark, d):
    p = late.probe(late.centroid_scores(asked(spark, d), stored(spark, d)[1]), PROBES)
    return p.select("qid", "i", "cid", F.round("s", 6).alias("s"), F.col("probe_rank").cast("long").alias("probe_rank"), F.round("impute", 6).alias("impute"))


@register("late_threshold", f"WITH {T}, {CEN}, {S} SELECT qid, cid, round(max(s), 6) AS best FROM s GROUP BY ALL HAVING max(s) >= 0.008")
def late_threshold(spark, d):
    s = late.centroid_scores(asked(spark, d), stored(spark, d)[1])
    return s.groupBy("qid", "cid").agg(F.max("s").alias("best")).where("best >= 0.008").withColumn("best", F.round("best", 6))


LEN = "len0 AS (SELECT cid, count(*) AS n_list FROM dec GROUP BY cid), nd AS (SELECT count(DISTINCT doc_id) AS n FROM tok)"
STOPPED = f"st0 AS (SELECT qid, i, avg(coalesce(n_list, 0)) AS mean_length FROM pr LEFT JOIN len0 USING (cid) GROUP BY ALL), st AS (SELECT qid, i, mean_length, l AND NOT bool_and(l) OVER (PARTITION BY qid) AS stopped FROM (SELECT *, mean_length > greatest({STOP} * n, {FLOOR}) AS l FROM st0, nd))"


def stop(spark, d) -> DataFrame:
    n = tokens(spark, d).agg(F.count_distinct("doc_id")).first()[0]
    p = late.probe(late.centroid_scores(asked(spark, d), stored(spark, d)[1]), PROBES)
    return late.stop_tokens(p, late.list_lengths(coded(spark, d)), n, STOP, FLOOR)


@register("late_stoplist", f"{HEAD}, {LEN}, {STOPPED} SELECT qid, i, round(mean_length, 6) AS mean_length, stopped FROM st")
def late_stoplist(spark, d):
    return stop(spark, d).select("qid", "i", F.round("mean_length", 6).alias("mean_length"), "stopped")


def warp_sql(score: str = "list_dot_product(qv, vh)", lists: str = "dec", cross: bool = True, impute: bool = True, tcs: float = 0.0, stopped: bool = False) -> str:
    """CTEs that end in w(qid, doc_id, score)."""
    pr = "pr2 AS (SELECT pr.* EXCLUDE (impute, stopped), st.stopped, CASE WHEN st.stopped THEN top ELSE impute END AS impute FROM pr JOIN st USING (qid, i))" if stopped else f"pr2 AS (SELECT * REPLACE ({'impute' if impute else '0::DOUBLE'} AS impute) FROM pr)"
    probed = "pd AS (SELECT DISTINCT qid, cid FROM pr2 WHERE NOT stopped" + (f" AND (qid, cid) IN (SELECT (qid, cid) FROM s GROUP BY qid, cid HAVING max(s) >= {tcs})" if tcs else "") + ")"
    en = f"en AS (SELECT qid, doc_id, i, {score} AS x, o.cid IS NOT NULL AS own FROM {lists} l JOIN pd USING (cid) JOIN q USING (qid) JOIN s USING (qid, i, cid) LEFT JOIN (SELECT qid, i, cid FROM pr2 WHERE NOT stopped) o USING (qid, i, cid)" + ("" if cross else " WHERE o.cid IS NOT NULL") + ")"
    fold = """fl AS (SELECT qid, i, any_value(impute) AS impute FROM pr2 GROUP BY ALL), bs AS (SELECT qid, sum(impute) AS base FROM fl GROUP BY qid),
be AS (SELECT qid, doc_id, i, max(x) AS x, bool_or(own) AS own FROM en GROUP BY ALL),
w AS (SELECT qid, doc_id, round(any_value(base) + sum(CASE WHEN own THEN x ELSE greatest(x, impute) END - impute), 6) AS score FROM be JOIN fl USING (qid, i) JOIN bs USING (qid) GROUP BY qid, doc_id)"""
    return f"{pr}, {probed}, {en}, {fold}"


def again(source: str, k: int = 5) -> str:
    """Exact scores of the candidates in ``source``."""
    rows = f"(SELECT qid, doc_id, i, list_dot_product(qv, vh) AS x FROM dec JOIN ({source}) USING (doc_id) JOIN q USING (qid))"
    return ranked(best(rows), k)


@register("warp_search", f"{HEAD}, {warp_sql()} {ranked('w', 5)}")
def warp_search(spark, d):
    return out(late.warp(coded(spark, d), asked(spark, d), stored(spark, d)[1], 5, nprobe=PROBES))


@register("warp_options", f"{HEAD}, {warp_sql(cross=False, impute=False, tcs=0.008)} {ranked('w', 5)}")
def warp_options(spark, d):
    return out(late.warp(coded(spark, d), asked(spark, d), stored(spark, d)[1], 5, nprobe=PROBES, cross=False, impute=False, tcs=0.008))


@register("warp_stoplist", f"{HEAD}, {LEN}, {STOPPED}, {warp_sql(stopped=True)} {ranked('w', 5)}")
def warp_stoplist(spark, d):
    return out(late.warp(coded(spark, d), asked(spark, d), stored(spark, d)[1], 5, nprobe=PROBES, stopped=stop(spark, d)))


@register("warp_rerank", f"{HEAD}, {warp_sql()} {again(f'SELECT qid, doc_id FROM ({ranked('w', DOCS)})')}")
def warp_rerank(spark, d):
    return out(late.warp(coded(spark, d), asked(spark, d), stored(spark, d)[1], 5, rerank=DOCS, nprobe=PROBES))


CANDIDATES = "SELECT DISTINCT qid, doc_id FROM dec JOIN (SELECT DISTINCT qid, cid FROM pr) USING (cid)"
APPROX = best(f"(SELECT qid, doc_id, i, s AS x FROM (SELECT DISTINCT doc_id, cid FROM dec) JOIN ({CANDIDATES}) USING (doc_id) JOIN s USING (qid, cid))")


@register("plaid_codes", f"{HEAD} {again(f'SELECT qid, doc_id FROM ({ranked(APPROX, DOCS)})')}")
def plaid_codes(spark, d):
    return out(late.plaid(coded(spark, d), asked(spark, d), stored(spark, d)[1], 5, PROBES, "codes", DOCS))


@register("plaid_ivf", f"{HEAD}, {warp_sql('s', '(SELECT DISTINCT cid, doc_id FROM dec)')} {again(f'SELECT qid, doc_id FROM ({ranked('w', DOCS)})')}")
def plaid_ivf(spark, d):
    return out(late.plaid(coded(spark, d), asked(spark, d), stored(spark, d)[1], 5, PROBES, "ivf", DOCS))


@register("plaid_sizing", """SELECT n_docs, n_tokens, pow(2, floor(log2(16 * sqrt(n_tokens))))::BIGINT AS centroids, least(1 + floor(16 * sqrt(120.0::DOUBLE * n_docs)), n_docs)::BIGINT AS sample_docs, least(floor(4 * sqrt(n_docs)), n_docs)::BIGINT AS nlist
FROM (SELECT count(DISTINCT vec_id // 10) AS n_docs, count(*) AS n_tokens FROM embeddings UNION ALL SELECT 1000000, 50000000)""")
def plaid_sizing(spark, d):
    counts = tokens(spark, d).agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_tokens"))
    return corpus.plaid_sizing(counts.unionByName(spark.createDataFrame([(1_000_000, 50_000_000)], "n_docs long, n_tokens long"))).select("n_docs", "n_tokens", "centroids", F.col("sample_docs").cast("long").alias("sample_docs"), F.col("nlist").cast("long").alias("nlist"))


@register("masked_mean", "SELECT doc_id, d, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) + 0 AS x FROM (SELECT doc_id, d, avg(x) AS x FROM (SELECT vec_id // 10 AS doc_id, unnest(range(64)) AS d, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE vec_id % 10 < 6) GROUP BY ALL)")
def masked_mean(spark, d):
    packed = tokens(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("t"))
    rows, mask = F.transform("t", lambda t: t["v"]), F.transform("t", lambda t: (t["pos"] < 6).cast("int"))
    spread = packed.select("doc_id", F.posexplode(vx.masked_mean(rows, mask, 64)).alias("d", "x"))
    return spread.select("doc_id", F.col("d").cast("long").alias("d"), (F.round("x", 6) + 0.0).alias("x"))


@register("late_assign_cells", f"WITH {T}, {CEN}, {OWN} SELECT doc_id, pos, cid FROM own")
def late_assign_cells(spark, d):
    """With all cells probed, a two-level assignment is that of all centroids."""
    c = centroids(spark, d)
    cells = late.coarse_cells(late.centroid_matrix(c))
    return late.assign(tokens(spark, d), c, cells, len(cells)).select("doc_id", "pos", F.col("cid").cast("int").alias("cid"))


@register("warp_two_level", f"{HEAD}, {warp_sql()} {ranked('w', 5)}")
def warp_two_level(spark, d):
    rows, c = stored(spark, d)
    cells = late.coarse_cells(late.centroid_matrix(c))
    return out(late.warp(rows, asked(spark, d), c, 5, nprobe=PROBES, cells=cells, cprobe=len(cells)))


@register("residual_pack", f"WITH {T}, {CEN}, {OWN}, {RES}, {CODEC}, {DEC} SELECT doc_id, pos, array_to_string(b, '') AS buckets FROM buk")
def residual_pack(spark, d):
    """Buckets through their packed form of two bits each."""
    def run(batches):
        for batch in batches:
            back = [quantize.unpack_residual(quantize.pack_residual(np.asarray(b), 2), len(b), 2) for b in batch["res"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "pos": batch["pos"], "buckets": ["".join(map(str, b)) for b in back]})

    r = rest(spark, d)
    return late.encode(r, late.train_codec(r)).select("doc_id", "pos", "res").mapInPandas(run, "doc_id long, pos long, buckets string")


@register("packed_ids", f"{HEAD} SELECT DISTINCT cid, doc_id FROM dec")
def packed_ids(spark, d):
    """The documents of each list through a stream of 20 bits a number."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["doc_id"].tolist()
        return pd.DataFrame({"cid": rows["cid"], "doc_id": quantize.unpack_ids(quantize.pack_ids(ids, 20), len(ids), 20)})

    lists = late.inverted_lists(coded(spark, d)).select(F.col("cid").cast("int").alias("cid"), "doc_id")
    return lists.groupBy("cid").applyInPandas(run, "cid int, doc_id long")


@register("late_token_kmeans", "SELECT unnest(range(16)) AS cid, true AS unit")
def late_token_kmeans(spark, d):
    c = late.train_tokens(tokens(spark, d), 16)
    return c.select("cid", (F.abs(vx.dot(F.col("c"), F.col("c")) - 1) < 2e-3).alias("unit"))
