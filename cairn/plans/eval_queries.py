"""Evaluation, corpus and cost-model queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus, dense, evaluation, ivf, netcost
from ..operators.lexical import hint
from ..sources.scratch import stash
from . import vector_queries as vq

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def results(spark, d) -> DataFrame:
    return dense.exact_search(vq.emb(spark, d), vq.asked(spark, d), 10, include_self=False)


def qrels(spark, d) -> DataFrame:
    e = vq.emb(spark, d)
    a = vq.asked(spark, d).select(F.col("vec_id").alias("qid"), "label")
    return e.join(hint(a), "label").where("vec_id <> qid").select("qid", F.col("vec_id").alias("id"))


def per_query(spark, d) -> DataFrame:
    q = vq.asked(spark, d).select(F.col("vec_id").alias("qid"))
    return evaluation.metrics(results(spark, d), qrels(spark, d), q, 10, vq.emb(spark, d).count())


RES = f"res AS ({vq.exact(vq.COS, 10, 'WHERE qid <> vec_id')}), rel AS (SELECT qid, e.vec_id AS id FROM q JOIN e AS a ON a.vec_id = qid JOIN e ON e.label = a.label WHERE e.vec_id <> qid)"
JUDGED = "jd AS (SELECT res.qid, rank, rel.id IS NOT NULL AS hit FROM res LEFT JOIN rel ON rel.qid = res.qid AND rel.id = res.id), nr AS (SELECT q.qid, count(rel.id) AS n_rel FROM q LEFT JOIN rel USING (qid) GROUP BY ALL)"
HEAD = f"WITH {vq.E}, {RES}, {JUDGED}"


@register("recall_at_k", f"{HEAD} SELECT qid, round(count(*) FILTER (hit) / any_value(n_rel), 6) AS recall FROM nr LEFT JOIN jd USING (qid) GROUP BY qid")
def recall_at_k(spark, d):
    return per_query(spark, d).select("qid", F.round("recall", 6).alias("recall"))


@register("success_at_k", f"{HEAD} SELECT qid, bool_or(coalesce(hit, false))::INT::DOUBLE AS success FROM nr LEFT JOIN jd USING (qid) GROUP BY qid")
def success_at_k(spark, d):
    return per_query(spark, d).select("qid", "success")


@register("mrr_at_k", f"{HEAD} SELECT qid, round(coalesce(1 / min(rank) FILTER (hit), 0), 6) AS mrr FROM nr LEFT JOIN jd USING (qid) GROUP BY qid")
def mrr_at_k(spark, d):
    return per_query(spark, d).select("qid", F.round("mrr", 6).alias("mrr"))


@register("ndcg_at_k", f"{HEAD} SELECT qid, round(sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(any_value(n_rel), 10) + 1), lambda r: 1 / log2(r + 1))), 6) AS ndcg FROM nr LEFT JOIN jd USING (qid) GROUP BY qid")
def ndcg_at_k(spark, d):
    return per_query(spark, d).select("qid", F.round("ndcg", 6).alias("ndcg"))


AUC = """ab AS (SELECT qid, hit, count(*) FILTER (NOT hit) OVER (PARTITION BY qid ORDER BY rank) AS above FROM jd), n AS (SELECT count(*) AS n_docs FROM e),
au AS (SELECT qid, (count(*) FILTER (hit) * (n_docs - n_rel) - coalesce(sum(above) FILTER (hit), 0) + (n_rel - count(*) FILTER (hit)) * (n_docs - n_rel - count(*) FILTER (NOT hit)) * 0.5::DOUBLE) / (n_rel * (n_docs - n_rel)) AS auc FROM nr LEFT JOIN ab USING (qid), n GROUP BY qid, n_rel, n_docs)"""


@register("auc", f"{HEAD}, {AUC} SELECT qid, round(auc, 6) AS auc FROM au")
def auc(spark, d):
    return per_query(spark, d).select("qid", F.round("auc", 6).alias("auc"))


@register("eval_by_kind", f"""{HEAD}, per AS (SELECT qid, qid % 3 AS kind, qid % 2 = 0 AS contains_word, count(*) FILTER (hit) / any_value(n_rel) AS recall, coalesce(1 / min(rank) FILTER (hit), 0) AS mrr FROM nr LEFT JOIN jd USING (qid) GROUP BY qid)
SELECT grouping_id(kind, contains_word) AS level, kind, contains_word, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM per GROUP BY GROUPING SETS ((), (kind), (kind, contains_word))""")
def eval_by_kind(spark, d):
    rows = per_query(spark, d).select("qid", (F.col("qid") % 3).alias("kind"), (F.col("qid") % 2 == 0).alias("contains_word"), "recall", "mrr")
    return evaluation.by_kind(rows, ["recall", "mrr"]).select("level", "kind", "contains_word", "n", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


PROBED = f"ap AS ({vq._ivf_sql(3, True)}), ex AS (WITH {vq.E} {vq.exact(vq.COS)})"


@register("recall_vs_exact", f"WITH {PROBED} SELECT ex.qid, count(ap.id) / 10 AS recall FROM ex LEFT JOIN ap ON ap.qid = ex.qid AND ap.id = ex.id GROUP BY ex.qid")
def recall_vs_exact(spark, d):
    return evaluation.recall_vs_exact(vq.ivf_search(spark, d), vq.dense_exact_cosine(spark, d))


@register("topk_overlap", f"WITH {PROBED} SELECT ap.qid, count(ex.id) / 10 AS overlap FROM ap LEFT JOIN ex ON ap.qid = ex.qid AND ap.id = ex.id GROUP BY ap.qid")
def topk_overlap(spark, d):
    return evaluation.overlap(vq.ivf_search(spark, d), vq.dense_exact_cosine(spark, d))


@register("list_agreement", f"WITH {PROBED}, a AS (SELECT qid, list(id ORDER BY rank) AS x FROM ap GROUP BY qid), b AS (SELECT qid, list(id ORDER BY rank) AS y FROM ex GROUP BY qid) SELECT count(*) AS n_queries, count(*) FILTER (x = y) AS n_equal, round(avg((x = y)::INT), 6) AS agreement FROM a FULL JOIN b USING (qid)")
def list_agreement(spark, d):
    return evaluation.agreement(vq.ivf_search(spark, d), vq.dense_exact_cosine(spark, d)).withColumn("agreement", F.round("agreement", 6))


@register("spearman", f"WITH {PROBED}, per AS (SELECT ap.qid, corr(ap.rank, ex.rank) AS rho, max((ap.rank = 1 AND ex.rank = 1)::INT) AS top1 FROM ap JOIN ex ON ap.qid = ex.qid AND ap.id = ex.id GROUP BY ap.qid) SELECT round(avg(rho), 6) AS spearman, round(avg(top1), 6) AS top1_agreement FROM per")
def spearman(spark, d):
    return evaluation.spearman(vq.ivf_search(spark, d), vq.dense_exact_cosine(spark, d)).select(F.round("spearman", 6).alias("spearman"), F.round("top1_agreement", 6).alias("top1_agreement"))


@register("latency_percentiles", "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    got = evaluation.distribution(spark.read.parquet(f"{d}/events.parquet"), "value", "event_type")
    return got.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99", "mean", "stdev")], "min", "max")


RUNS = "SELECT user_id % 7 AS system, user_id AS config, (avg(value) - floor(avg(value) / 100) * 100) / 100 AS recall, count(*) AS cost FROM events GROUP BY user_id"


@register("best_at_recall", f"SELECT system, arg_min(config, (cost, config)) AS config, min(cost) AS cost FROM (SELECT * REPLACE (round(recall, 4) AS recall) FROM ({RUNS})) WHERE recall >= 0.3 GROUP BY system")
def best_at_recall(spark, d):
    v = F.avg("value")
    runs = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(((v - F.floor(v / 100) * 100) / 100).alias("recall"), F.count(F.lit(1)).alias("cost"))
    rows = runs.select((F.col("user_id") % 7).alias("system"), F.col("user_id").alias("config"), F.round("recall", 4).alias("recall"), "cost")
    return evaluation.best_at_recall(rows, 0.3)


@register("interleave_kinds", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS slot FROM events")
def interleave_kinds(spark, d):
    rows = corpus.interleave(spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type"), "event_type", "event_id")
    return rows.withColumn("slot", F.col("slot").cast("long"))


@register("sample_per_kind", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('s1' || event_type || event_id), event_id) AS slot FROM events QUALIFY slot <= 25")
def sample_per_kind(spark, d):
    rows = corpus.sample_per_kind(spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type"), "event_type", "event_id", 25, "s1")
    return rows.withColumn("slot", F.col("slot").cast("long"))


# request traces from events
READS = "reads AS (SELECT user_id AS trace_id, extract(hour FROM ts) AS round, 'f' AS file, event_id * 4096 AS offs, 4096 * (1 + event_id % 3) AS len, extract(minute FROM ts)::DOUBLE AS t_issue_ms FROM events)"


def reads(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("trace_id"), F.hour("ts").cast("long").alias("round"), F.lit("f").alias("file"), (F.col("event_id") * 4096).alias("offset"), (4096 * (1 + F.col("event_id") % 3)).alias("length"), F.minute("ts").cast("double").alias("t_issue_ms"))


@register("first_per_session", "SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS slot FROM events QUALIFY slot <= 3")
def first_per_session(spark, d):
    rows = corpus.first_per_session(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type"), "user_id", "event_type", "event_id", 3)
    return rows.withColumn("slot", F.col("slot").cast("long"))


@register("coalesce_ranges", f"""WITH {READS}, m AS (SELECT *, max(offs + len) OVER (PARTITION BY trace_id, round ORDER BY offs, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM reads),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR offs > reach + 65536 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, round ORDER BY offs, len ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT trace_id, round, any_value(file) AS file, min(offs) AS "offset", max(offs + len) - min(offs) AS length, min(t_issue_ms) AS t_issue_ms, count(*) AS n_reads FROM g GROUP BY trace_id, round, run""")
def coalesce_ranges(spark, d):
    return netcost.coalesce_ranges(reads(spark, d), 65_536)


@register("rle_runs", """WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, event_id FROM events), p AS (SELECT user_id, r, event_id // 200 AS page FROM t),
m AS (SELECT *, CASE WHEN r - page = lag(r - page) OVER (PARTITION BY user_id ORDER BY r) THEN 0 ELSE 1 END AS new FROM p), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, min(r) AS first_row, min(page) AS first_page, count(*) AS n FROM g GROUP BY user_id, run""")
def rle_runs(spark, d):
    from pyspark.sql.window import Window

    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id")
    rows = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")).withColumn("page", F.floor(F.col("event_id") / 200))
    return netcost.runs(rows, "r", "page", "user_id")


@register("warm_cache_misses", """WITH t AS (SELECT DISTINCT user_id AS session, extract(day FROM ts) AS query_no, event_id % 97 AS page FROM events), f AS (SELECT *, min(query_no) OVER (PARTITION BY session, page) AS first FROM t)
SELECT session, query_no, count(*) AS n_pages, count(*) FILTER (query_no = first) AS n_new FROM f GROUP BY ALL""")
def warm_cache_misses(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return netcost.warm_misses(e.select(F.col("user_id").alias("session"), F.dayofmonth("ts").cast("long").alias("query_no"), (F.col("event_id") % 97).alias("page")))


@register("net_lower_bound", f"WITH {READS}, per AS (SELECT trace_id, round, count(*) AS n, sum(len) AS bytes FROM reads GROUP BY ALL) SELECT trace_id, round(sum(165.0::DOUBLE + bytes / least(8100 * 125.0::DOUBLE, n * 2000 * 125.0::DOUBLE) * 1000 + 1.5::DOUBLE), 6) AS ms FROM per GROUP BY trace_id")
def net_lower_bound(spark, d):
    r = reads(spark, d)
    rounds = r.select("trace_id", "round").distinct().withColumn("cpu_ms", F.lit(1.5))
    return netcost.lower_bound(r, rounds, netcost.profile("4g", request_kbps=2000)).withColumn("ms", F.round("ms", 6))


BLOCKS = "b AS (SELECT DISTINCT user_id AS round_id, event_id * 3 AS rs, event_id * 3 + 1 + event_id % 2 AS re FROM events)"


@register("plan_requests", f"""WITH {BLOCKS}, w AS (SELECT round_id, count(*) AS m, max(re) - min(rs) AS span, sum(re - rs) AS exact FROM b GROUP BY round_id),
g AS (SELECT round_id, lead(rs) OVER (PARTITION BY round_id ORDER BY rs) - re AS gap, rs FROM b), o AS (SELECT round_id, gap, row_number() OVER (PARTITION BY round_id ORDER BY gap DESC, rs) AS j, sum(gap) OVER (PARTITION BY round_id ORDER BY gap DESC, rs ROWS UNBOUNDED PRECEDING) AS saved FROM g WHERE gap IS NOT NULL),
c AS (SELECT round_id, m, j + 1 AS n, ceil((j + 1) / 6) * 165 + (span - saved) * 4096 / 1012.5::DOUBLE AS ms, 1 AS late FROM o JOIN w USING (round_id) WHERE (j + 1) % 6 = 0 AND j + 1 < m AND m > 6 UNION ALL SELECT round_id, m, m, ceil(m / 6) * 165 + exact * 4096 / 1012.5::DOUBLE, 0 FROM w)
SELECT round_id, any_value(m) AS n_ranges, arg_min(n, (ms, late, n)) AS n_requests, round(min(ms), 6) AS ms FROM c GROUP BY round_id""")
def plan_requests(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    b = e.select(F.col("user_id").alias("round_id"), (F.col("event_id") * 3).alias("rs"), (F.col("event_id") * 3 + 1 + F.col("event_id") % 2).alias("re")).distinct()
    got = netcost.plan_requests(b, 4096, 6, 165.0, 1012.5)
    return got.select("round_id", "n_ranges", F.col("n_requests").cast("long").alias("n_requests"), F.round("ms", 6).alias("ms"))


@register("request_counters", f"WITH {READS} SELECT trace_id, count(DISTINCT round) AS rounds, count(*) AS requests, sum(len)::BIGINT AS bytes, 0::BIGINT AS hits FROM reads GROUP BY trace_id")
def request_counters(spark, d):
    return netcost.counters(reads(spark, d))


@register("cpu_gaps", """WITH r AS (SELECT user_id AS trace_id, extract(day FROM ts) AS round, min(extract(hour FROM ts) * 60 + extract(minute FROM ts) + extract(day FROM ts) * 1440)::DOUBLE AS a, max(extract(hour FROM ts) * 60 + extract(minute FROM ts) + extract(day FROM ts) * 1440)::DOUBLE AS z FROM events GROUP BY ALL)
SELECT trace_id, round, greatest(a - coalesce(lag(z) OVER (PARTITION BY trace_id ORDER BY round), 0), 0) AS cpu_ms FROM r""")
def cpu_gaps(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    minute = (F.hour("ts") * 60 + F.minute("ts") + F.dayofmonth("ts") * 1440).cast("double")
    return netcost.cpu_gaps(e.select(F.col("user_id").alias("trace_id"), F.dayofmonth("ts").cast("long").alias("round"), minute.alias("start_ms"), minute.alias("end_ms")))


@register("net_profiles", "SELECT * FROM (VALUES ('4g', 165::DOUBLE, 8100::DOUBLE, 0, 0::DOUBLE), ('4g,h1', 165, 8100, 6, 0), ('lte,h2,cold', 70, 12000, 100, 140), ('slow-3g', 2000, 400, 0, 0), ('lighthouse,cold', 150, 1638.4, 0, 300)) t(name, latency_ms, link_kbps, max_concurrent, connect_ms)")
def net_profiles(spark, d):
    return netcost.profiles(spark, ["4g", "4g,h1", "lte,h2,cold", "slow-3g", "lighthouse,cold"])


def _rounds(r: DataFrame) -> DataFrame:
    return r.select("trace_id", "round").distinct().withColumn("cpu_ms", F.lit(1.5))


@register("net_simulate", f"WITH {READS}, per AS (SELECT trace_id, round, sum(len) AS bytes FROM reads GROUP BY ALL) SELECT trace_id, round(sum(165 + bytes / 1012.5::DOUBLE + 1.5::DOUBLE), 3) AS ms FROM per GROUP BY trace_id")
def net_simulate(spark, d):
    """Requests that are issued together and share a fixed link end when all bytes are there."""
    r = reads(spark, d).drop("t_issue_ms")
    return netcost.simulate(r, _rounds(r), netcost.profile("4g")).select("trace_id", F.round("ms", 3).alias("ms"))


@register("net_simulate_queued", f"WITH {READS}, per AS (SELECT trace_id, round, count(*) AS n, sum(len) AS bytes FROM reads GROUP BY ALL) SELECT trace_id, round(sum(n * 165 + bytes / 1012.5::DOUBLE + 1.5::DOUBLE) + 330, 3) AS ms, 1 AS n_connections FROM per GROUP BY trace_id")
def net_simulate_queued(spark, d):
    """One connection, opened once, serves one request after another."""
    r = reads(spark, d).drop("t_issue_ms")
    return netcost.simulate(r, _rounds(r), netcost.profile("4g,cold", max_concurrent=1)).select("trace_id", F.round("ms", 3).alias("ms"), "n_connections")


@register("net_simulate_shaped")
def net_simulate_shaped(spark, d):
    """Drawn latencies, a link that changes, slow start and requests issued in the course of a round."""
    r = reads(spark, d)
    return netcost.simulate(r, _rounds(r), netcost.profile("lte-poor,h1,slowstart,cold"))


@register("sim_vs_bound", f"WITH {READS} SELECT count(DISTINCT trace_id) AS n, true AS above FROM reads")
def sim_vs_bound(spark, d):
    r = reads(spark, d)
    simulated = stash(netcost.simulate(r, _rounds(r), netcost.profile("4g,h1,slowstart")), "simulated")
    low = netcost.lower_bound(r, _rounds(r), netcost.profile("4g")).withColumnRenamed("ms", "bound_ms")
    both = evaluation.distribution(simulated.join(low, "trace_id").withColumn("ratio", F.col("ms") / F.col("bound_ms")), "ratio")
    return both.select("n", (F.col("min") >= 1 - 1e-9).alias("above"))


@register("log_requests", """WITH l AS (SELECT user_id AS trace_id, extract(hour FROM ts) AS round, event_id AS seq, event_id * 4096 AS offs, 4096 * (1 + event_id % 3) AS len, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id // 400 END AS req FROM events),
m AS (SELECT *, CASE WHEN req = lag(req) OVER (PARTITION BY trace_id, round ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM l), g AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id, round ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT trace_id, round, min(seq) AS idx, arg_min(offs, seq) AS "offset", sum(len)::BIGINT AS length, count(*) AS n_ranges FROM g GROUP BY trace_id, round, run""")
def log_requests(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    log = e.select(F.col("user_id").alias("trace_id"), F.hour("ts").cast("long").alias("round"), F.col("event_id").alias("seq"), (F.col("event_id") * 4096).alias("offset"), (4096 * (1 + F.col("event_id") % 3)).alias("length"), F.lit(0.0).alias("start_ms"), F.lit(1.0).alias("end_ms"), F.when(F.col("event_id") % 5 != 0, F.floor(F.col("event_id") / 400)).alias("req"))
    return netcost.requests_of_log(log).drop("start_ms", "end_ms")


@register("cache_sessions", """WITH t AS (SELECT user_id AS session, event_id AS seq, event_id % 97 AS page, lag(event_id) OVER (PARTITION BY user_id, event_id % 97 ORDER BY event_id) AS prev FROM events),
b AS (SELECT t.session, t.seq, count(DISTINCT u.page) AS others FROM t JOIN t u ON u.session = t.session AND u.seq > t.prev AND u.seq < t.seq GROUP BY ALL),
h AS (SELECT t.session, t.prev IS NOT NULL AND coalesce(others, 0) < 16 AS hit FROM t LEFT JOIN b USING (session, seq))
SELECT session, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM h GROUP BY session""")
def cache_sessions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return netcost.cache_sessions(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 97).alias("page")), 16)


@register("ivf_probe_ranks", f"WITH {vq.E}, {vq.LISTS} SELECT qid, list_id::BIGINT AS list_id, row_number() OVER (PARTITION BY qid ORDER BY {vq.L2.format('qv', 'c')}, list_id) AS probe_rank FROM q, cen QUALIFY probe_rank <= 3")
def ivf_probe_ranks(spark, d):
    c = ivf.label_centroids(vq.emb(spark, d))
    cen = spark.createDataFrame([(i, [float(x) for x in own]) for i, own in enumerate(c)], "list_id long, c array<double>")
    q = vq.asked(spark, d).select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("q"))
    return ivf.ranked_probes(q, cen, 3).select("qid", "list_id", F.col("probe_rank").cast("long").alias("probe_rank"))
