import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.functions import vectors as vx
from cairn.functions.sampling import min_p_sample
from cairn.operators import corpus, dense, evaluation, graph, ivf, late, lexical, netcost, netmodel, quantize
from cairn.plans.session import SearchSession, parse_options, register_functions
from cairn.plans.snapshot import Snapshot, check_parameters, discover, sizes
from cairn.sources import readers


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(40, size=1500)] + 0.35 * rng.normal(size=(1500, 32))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors(spark, clustered):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered)], "vec_id long, embedding array<double>").repartition(3).cache()


def truth(x, q, k, metric="cosine"):
    d = np.round(((q[:, None] - x[None]) ** 2).sum(2) if metric == "l2" else 1 - q @ x.T, 6)
    return [np.lexsort((np.arange(len(x)), row))[:k].tolist() for row in d]


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, []).append((r["rank"], r["id"]))
    return {q: [i for _, i in sorted(v)] for q, v in out.items()}


def recall(found, want):
    return np.mean([len(set(found.get(n, [])) & set(w)) / len(w) for n, w in enumerate(want)])


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_exact_search(vectors, clustered, metric):
    got = lists(dense.exact_search(vectors, vectors.where("vec_id < 15"), 10, metric))
    assert [got[n] for n in range(15)] == truth(clustered, clustered[:15], 10, metric)


def test_k_rules(vectors):
    assert [dense.resolve_k(None), dense.resolve_k(5, 3), dense.resolve_k(0), dense.resolve_k(10**9), dense.resolve_k(3, 9)] == [10, 3, 0, 100_000, 3]
    assert dense.exact_search(vectors, vectors.limit(2), 0).count() == 0
    with pytest.raises(ValueError):
        dense.exact_search(vectors, vectors, metric="hamming")


def test_vectors_of_another_length_raise(spark, vectors):
    bad = vectors.unionByName(spark.createDataFrame([(9999, [1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="32 elements"):
        dense.exact_search(bad.coalesce(1), vectors.where("vec_id < 2")).collect()


@pytest.fixture(scope="module")
def book(vectors):
    return quantize.train_pq(vectors, 8, codes=32).rounded()


@pytest.mark.parametrize("shards", [1, 3])
def test_graph_search_recall(vectors, clustered, book, tmp_path, shards):
    want = truth(clustered, clustered[:20], 10)
    index = graph.build(vectors, book, shards=shards, stored="f32").save(str(tmp_path))
    asked = vectors.where("vec_id < 20")
    for mode in (1, 2, 3):
        assert recall(lists(graph.search(index, asked, ef=100, rerank=mode)), want) >= 0.9
    assert recall(lists(graph.search(index, asked, ef=100, entry_points=0)), want) >= 0.9
    coded = recall(lists(graph.search(index, asked, ef=100, rerank=0)), want)
    assert 0.2 < coded < 0.9
    gone = vectors.where("vec_id % 2 = 0")
    assert all(i % 2 for own in lists(graph.search(index, asked, deleted=gone)).values() for i in own)
    nodes = graph.average_degree(index).first()
    assert nodes.nodes == 1500 and 1 < nodes.degree <= 32


def test_graph_of_codes_alone(vectors, clustered, book):
    index = graph.build(vectors, book, shards=1, stored="none")
    assert 0.2 < recall(lists(graph.search(index, vectors.where("vec_id < 20"), ef=100)), truth(clustered, clustered[:20], 10)) < 0.9


def test_graph_insert(vectors, clustered, book):
    index = graph.build(vectors.where("vec_id < 1400"), book, shards=2, stored="f32")
    grown = graph.insert(index, vectors.where("vec_id >= 1400"))
    asked = vectors.where("vec_id >= 1480")
    found = lists(graph.search(grown, asked, ef=100))
    assert np.mean([len(set(found[n]) & set(w)) / 10 for n, w in zip(range(1480, 1500), truth(clustered, clustered[1480:], 10), strict=True)]) >= 0.85
    assert graph.average_degree(grown).first().nodes == 1500


def test_levels():
    ids = np.arange(20_000)
    levels = graph.levels_of(ids)
    assert np.bincount(levels)[1] / 20_000 == pytest.approx(15 / 256, rel=0.15) and levels.max() <= 16
    assert set(graph.entry_set(ids, 30).tolist()) >= set(np.flatnonzero(levels == levels.max()).tolist())


def test_walk(spark):
    adjacency = spark.createDataFrame([(1, [2, 3]), (2, [4]), (4, [1])], "node long, nbrs array<long>")
    got = graph.walk(spark.createDataFrame([(7, 1)], "qid long, node long"), adjacency, 3).collect()
    assert {(r.node, r["round"]) for r in got} == {(1, 0), (2, 1), (3, 1), (4, 2)}


@pytest.mark.parametrize("form", ["int8", "f16", "f32"])
def test_stored_vectors(spark, form):
    x = np.random.default_rng(1).normal(size=(7, 5)).astype(np.float32)
    assert np.abs(quantize.unpack_vectors(quantize.pack_vectors(x, form), form, 5) - x).max() <= {"int8": 0.02, "f16": 2e-3, "f32": 0}[form]
    df = spark.createDataFrame([(0, None), (1, x[0].tolist())], "id long, v array<float>")
    got = {r.id: r.v for r in quantize.unpacked(quantize.packed(df, "v", form), "v", form, 5).collect()}
    assert got[0] is None and len(got[1]) == 5


def test_codebook_storage(book):
    for form, limit in (("f16", 1e-3), ("int8", 0.02)):
        assert np.abs(book.rounded(form).centroids - book.centroids).max() < limit
    again = quantize.Codebook.from_bytes(quantize.Codebook(book.centroids, np.eye(32)).to_bytes())
    assert (again.centroids == book.centroids).all() and (again.rotation == np.eye(32)).all()
    assert [quantize.centroid_form(n) for n in (1023, 1024)] == ["int8", "pq"] and quantize.centroid_form(9, "f16") == "f16"


def test_ivf_index_is_stored_and_grows(vectors, clustered, tmp_path):
    c = ivf.train_centroids(vectors, 20, 5)
    index = ivf.save(ivf.build(vectors.where("vec_id < 1400"), c, quantize.train_pq(vectors, 8, codes=32)), str(tmp_path))
    plan = index.rows.where("list_id IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(list_id" in plan
    grown = ivf.insert(index, vectors.where("vec_id >= 1400"))
    assert recall(lists(ivf.search(grown, vectors.where("vec_id < 20"), nprobe=20, rerank_k=200)), truth(clustered, clustered[:20], 10)) >= 0.9


def test_nearest_tells_ties():
    c = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    assert ivf.nearest(c, np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 2.0]])).tolist() == [0, 0, 1]


def test_many_queries_go_in_parts(vectors, clustered, monkeypatch):
    monkeypatch.setattr(dense, "MAX_QUERY_BYTES", 2000)
    monkeypatch.setattr(dense, "TILE_BYTES", 4000)
    got = lists(dense.exact_search(vectors, vectors.where("vec_id < 25"), 5))
    assert [got[n] for n in range(25)] == truth(clustered, clustered[:25], 5)
    assert dense.exact_search(vectors, vectors.limit(0), 5).count() == 0


def test_prune_keeps_what_nothing_kept_is_nearer_to():
    x = np.array([[1.0, 0], [0.9, 0.1], [0.89, 0.12], [0.2, -1.0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = graph.prune(x[0], np.array([1, 2, 3]), x, 8)
    assert kept == [1, 3]
    assert len(graph.prune(x[0], np.array([1, 2, 3]), x, 1)) == 1


def test_ivf_recall_and_full_probe(vectors, clustered):
    c = ivf.train_centroids(vectors, 30)
    book = quantize.train_pq(vectors, 8, codes=64)
    index = ivf.build(vectors, c, book, residual=False)
    q = vectors.where("vec_id < 20")
    want = truth(clustered, clustered[:20], 10)
    some = recall(lists(ivf.search(index, q, nprobe=8, rerank_k=64)), want)
    assert some >= 0.95
    assert some >= recall(lists(ivf.search(index, q, nprobe=8, rerank=False)), want)
    flat = ivf.build(vectors, np.zeros((1, 32)), book, residual=False)
    assert lists(ivf.search(index, q, nprobe=30, rerank=False)) == lists(ivf.search(flat, q, nprobe=1, rerank=False))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("residual", [True, False])
def test_ivf_codes_equal_decoded_distances(vectors, clustered, metric, residual):
    c = ivf.train_centroids(vectors, 6, 3)
    first = clustered[:16] - (c[ivf.nearest(c, clustered[:16])] if residual else 0)
    book = quantize.Codebook(np.ascontiguousarray(first.reshape(16, 4, -1).transpose(1, 0, 2)))
    own = ivf.nearest(c, clustered)
    decoded = book.decode(book.encode(clustered - c[own] if residual else clustered)) + (c[own] if residual else 0)
    got = lists(ivf.search(ivf.build(vectors, c, book, metric, residual), vectors.where("vec_id < 6"), nprobe=6, rerank=False))
    q = clustered[:6]
    d = np.round(((q[:, None] - decoded[None]) ** 2).sum(2) if metric == "l2" else 1 - q @ decoded.T, 6)
    assert [got[n] for n in range(6)] == [np.lexsort((np.arange(1500), row))[:10].tolist() for row in d]


def test_kmeans_lowers_inertia_and_fills_clusters(clustered):
    def inertia(c):
        return ((clustered[:, None] - c[None]) ** 2).sum(2).min(1).sum()

    assert inertia(quantize.kmeans(clustered, 20, 20)) < inertia(quantize.kmeans(clustered, 20, 1))
    assert len(np.unique(quantize.kmeans(clustered[:5], 8), axis=0)) == 5


def test_opq_error_and_rotation(vectors, clustered):
    plain, turned = quantize.train_pq(vectors, 4, codes=16), quantize.train_opq(vectors, 4, codes=16)
    r = turned.rotation
    assert np.allclose(r @ r.T, np.eye(32), atol=1e-9)
    error = lambda b: ((b.turned(clustered) - b.decode(b.encode(clustered))) ** 2).sum()
    assert error(turned) <= 1.1 * error(plain)


def test_scalar_codecs():
    assert quantize.half_round_trip(np.array([1.0, 1e-8, 65504, 1 + 2**-11, 1 + 3 * 2**-11])).tolist() == [1.0, 0.0, 65504.0, 1.0, 1 + 2**-9]
    b = np.array([1, 2, 3, 0, 1])
    for bits in (2, 4):
        assert quantize.unpack_residual(quantize.pack_residual(b, bits), 5, bits).tolist() == b.tolist()
    assert quantize.pack_residual(np.array([1, 2, 3, 0]), 2) == bytes([0b10011100])
    assert quantize.unpack_ids(quantize.pack_ids([5, 0, 31, 7], 5), 4, 5) == [5, 0, 31, 7]
    assert [quantize.varint(n) for n in (0, 127, 128, 300)] == [b"\0", b"\x7f", b"\x80\x01", b"\xac\x02"]
    x = np.array([[0.5, -1.0, 0.25]])
    assert np.abs(quantize.quantize_centroids(x, 8) - x).max() < 0.01 and np.abs(quantize.quantize_centroids(x, 4) - x).max() < 0.1
    assert [quantize.default_m(d) for d in (384, 96)] == [64, 32]


def test_late_search_finds_its_source(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(16, 16))
    rows = []
    for doc in range(60):
        for pos in range(rng.integers(8, 16)):
            v = centres[rng.integers(16)] + 0.5 * rng.normal(size=16)
            rows.append((doc, pos, (v / np.linalg.norm(v)).tolist()))
    tokens = spark.createDataFrame(rows, "doc_id long, pos long, v array<double>").cache()
    cen = spark.createDataFrame([(i, (c / np.linalg.norm(c)).tolist()) for i, c in enumerate(centres)], "cid long, c array<double>")
    q = tokens.where("doc_id = 7 AND pos BETWEEN 2 AND 5").select("doc_id", F.col("pos").alias("i"), F.col("v").alias("q")).withColumnRenamed("doc_id", "qid")
    coded, codec = late.build(tokens, cen)
    assert codec.bits == 2
    for got in (late.maxsim(tokens, q, 3), late.maxsim(coded, q, 3, "v_hat"), late.warp(coded, q, cen, 3, nprobe=4), late.warp(coded, q, cen, 3, rerank=10, nprobe=4), late.plaid(coded, q, cen, 3), late.plaid(coded, q, cen, 3, approx="ivf")):
        assert 7 in [r.doc_id for r in got.collect()]
    exact = {r.doc_id: r.score for r in late.maxsim(coded, q, 100, "v_hat").collect()}
    full = {r.doc_id: r.score for r in late.warp(coded, q, cen, 100, nprobe=16).collect()}
    assert full == pytest.approx(exact, abs=1e-5)
    late.save(tokens, cen, str(tmp_path))
    again, stored = late.load(spark, str(tmp_path))
    assert [tuple(r) for r in late.warp(again, q, stored, 5, nprobe=4).collect()] == [tuple(r) for r in late.warp(coded, q, cen, 5, nprobe=4).collect()]
    s = SearchSession(spark)
    s.register("tokens", "late", (again, stored))
    assert s.search(q, "late", 3, **parse_options("layout=plaid approx=ivf;nprobe=4, unknown=1")).count() == 3
    assert s.search(q, "late", 3, impute=0).first().doc_id == 7


def test_two_level_assignment(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(200, 16))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    v = c[rng.integers(200, size=900)] + 0.1 * rng.normal(size=(900, 16))
    tokens = spark.createDataFrame([(k, 0, x.tolist()) for k, x in enumerate(v)], "doc_id long, pos long, v array<double>")
    cen = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(c)], "cid long, c array<double>")
    whole = {r.doc_id: r.cid for r in late.assign(tokens, cen).collect()}
    assert whole == dict(enumerate((v @ c.T).argmax(1).tolist()))
    cells = late.coarse_cells(c)
    near = {r.doc_id: r.cid for r in late.assign(tokens, cen, cells, 5).collect()}
    assert np.mean([near[k] == whole[k] for k in whole]) > 0.9
    assert {r.doc_id: r.cid for r in late.assign(tokens, cen, cells, len(cells)).collect()} == whole
    trained = late.train_tokens(tokens, 20).collect()
    assert len(trained) == 20 and all(abs(np.linalg.norm(r.c) - 1) < 2e-3 for r in trained)


def test_bm25_variants_agree(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a d"), (3, "b b b"), (4, None), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b"), (2, "?")], "qid long, text string")
    bm25 = lexical.search(docs, q).collect()
    toks = lexical.tokenized(docs).select("doc_id", "dl")
    assert bm25 == lexical.search(docs, q, ranking="bm25-rerank").collect() == lexical.search(docs, q, ranking="bm25-prefetch").collect()
    assert bm25 == lexical.search(docs, q, ranking="bm25dl", length=F.col("dl")).collect() and toks.count() == 5
    assert {r.doc_id for r in lexical.search(docs, q, mode="and").collect()} == {1}
    assert [r.doc_id for r in lexical.search(docs, q, ranking="none").collect()] == [1, 2, 3]
    assert lexical.search(docs, q, 0).count() == 0 and lexical.search(docs.limit(0), q).count() == 0
    with pytest.raises(ValueError):
        lexical.search(docs, q, ranking="tf").collect()


def test_stored_text_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Élan vital élan"), (2, "plain elan"), (3, None), (4, "other words")], "doc_id long, text string")
    index = lexical.TextIndex.build(docs, str(tmp_path))
    queries = spark.createDataFrame([(1, "ÉLAN"), (2, "words zzz")], "qid long, text string")
    for ranking in ("bm25", "bm25c", "bm25-rerank", "none"):
        for mode in ("or", "and"):
            found = [sorted(map(tuple, lexical.search(x, queries, 5, ranking, mode).collect())) for x in (docs, index)]
            assert found[0] == found[1] and any(r[0] == 1 for r in found[0])
    plan = index.postings.where(F.col("term").isin("elan"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,elan)]" in plan or "In(term" in plan


def test_encoder_inputs(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from cairn.functions import encoders

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["\u2003 two words\u00a0\x1c", "", None, "many words " * 100, "ΟΔΟΣ"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id long, text string")
    got = {r.id: r for r in df.select("id", encoders.token_ids(F.col("text"), path).alias("ids"), encoders.encoder_input(F.col("text"), path, 16, 7).alias("cut"), encoders.strip(F.col("text")).alias("s"), encoders.lower_each(F.col("text")).alias("l")).collect()}
    own = Tokenizer.from_file(path)
    for n, t in enumerate(texts):
        ids = own.encode((t or "").strip()).ids
        assert got[n].ids == ids and got[n].s == (None if t is None else t.strip())
        if n == 3:
            assert got[n].cut == [ids[0], 7, *ids[1:14], ids[-1]] and len(got[n].cut) == 16
        elif n == 0:
            assert got[n].cut == [ids[0], 7, *ids[1:]]
    assert got[4].l == "ΟΔΟσ"


def test_options():
    assert parse_options("nprobe=8 layout=plaid;tcs=0.5,odd=1 k=x impute") == {"nprobe": 8, "layout": "plaid", "tcs": 0.5, "k": 0}
    assert parse_options(None) == {}


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.tokens(F.lit("Ça VA, l'Été_2 ß")).alias("t"), tx.match_expression(F.lit("What's b what"), "and").alias("m"), tx.match_expression(F.lit("!")).alias("n"), tx.clean_query(F.lit('Search engine query: query - "the cat"\nmore')).alias("c"), tx.first_words(F.lit(" a  b\nc "), 2).alias("f")
    ).first()
    assert row.t == ["ca", "va", "l", "ete", "2", "ß"] and row.m == '"what" AND "s" AND "b"' and row.n is None and row.c == "the cat" and row.f == "a b"


def test_vector_functions(spark):
    row = spark.range(1).select(
        vx.normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), vx.int8_encode(F.array(F.lit(1.0), F.lit(-0.5))).alias("e"), vx.bucketize(F.array(F.lit(0.0), F.lit(0.1), F.lit(0.2)), [0.0, 0.1]).alias("b"), vx.parse_vector(F.lit("[1, 2.5]"), 2).alias("p")
    ).first()
    assert row.z == [0.0, 0.0] and row.e.q == [127, -64] and row.b == [0, 1, 2] and row.p == [1.0, 2.5]
    with pytest.raises(Exception, match="expected 2 numbers"):
        spark.range(1).select(vx.parse_vector(F.lit("[1]"), 2)).collect()


def test_metrics_by_hand(spark):
    res = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10)], "qid long, rank int, id long")
    rel = spark.createDataFrame([(1, 11), (1, 99), (2, 50)], "qid long, id long")
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    got = {r.qid: r for r in evaluation.metrics(res, rel, q, 2, 100).collect()}
    assert got[1].recall == 0.5 and got[1].mrr == 0.5 and got[1].success == 1.0
    assert got[1].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got[1].auc == pytest.approx((97 + 0.5 * 96) / (2 * 98))
    assert got[2].mrr == 0.0 and got[2].auc == pytest.approx(0.5 * 98 / 99) and got[3].recall is None and got[3].auc is None


def test_splitmix_known_answers():
    rng = corpus.SplitMix64(0)
    assert [rng.next() for _ in range(3)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
    assert sorted(corpus.det_shuffle(list(range(50)), 7)) == list(range(50)) and corpus.det_shuffle([1, 2, 3], 1) == corpus.det_shuffle([1, 2, 3], 1)


def best_plan(ranges, block, max_req, rtt, speed):
    m = len(ranges)
    costs = []
    for cuts in range(1 << (m - 1)):
        groups, start = [], ranges[0][0]
        for k in range(m - 1):
            if cuts >> k & 1:
                groups.append((start, ranges[k][1]))
                start = ranges[k + 1][0]
        groups.append((start, ranges[-1][1]))
        costs.append(math.ceil(len(groups) / max_req) * rtt + sum(b - a for a, b in groups) * block / speed)
    return min(costs)


def test_planner_against_all_cuts(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for n in range(12):
        at, own = 0, []
        for _ in range(rng.integers(1, 11)):
            at += int(rng.integers(1, 60))
            own.append((at, at + int(rng.integers(1, 5))))
            at = own[-1][1]
        rows += [(n, a, b) for a, b in own]
        if len(own) > 3:
            want[n] = best_plan(own, 4096, 3, 40.0, 1000.0)
    got = {r.round_id: r.ms for r in netcost.plan_requests(spark.createDataFrame(rows, "round_id long, rs long, re long"), 4096, 3, 40.0, 1000.0).collect()}
    assert len(got) == 12 and {n: got[n] for n in want} == pytest.approx(want)


def test_simulation_and_bound(spark):
    reads = spark.createDataFrame([(1, 0, 0, 1000), (1, 0, 5000, 3000), (1, 1, 0, 100)], "trace_id long, round long, offset long, length long")
    rounds = spark.createDataFrame([(1, 0, 5.0), (1, 1, 2.0), (1, 2, 4.0)], "trace_id long, round long, cpu_ms double")
    net = netcost.profile("4g")
    ms = netcost.simulate(reads, rounds, net).first().ms
    bound = netcost.lower_bound(reads, rounds, net).first().ms
    assert ms == pytest.approx(bound) == pytest.approx(11 + 2 * 165 + 4100 / 1012.5)
    slow = netcost.simulate(reads, rounds, netcost.profile("4g", max_concurrent=1)).first()
    assert slow.ms == pytest.approx(ms + 165) and slow.n_connections == 1 and slow.max_wait_ms > 165


def net(**fields):
    return netmodel.profile("none", **fields)


def test_profiles():
    assert [netcost.profile("4g,h1,cold", latency_ms=100)[k] for k in ("link_kbps", "max_concurrent", "connect_ms", "latency_ms")] == [8100, 6, 330, 100]
    assert netcost.profile("lte,h2,cold")["connect_ms"] == 140
    for bad in ("5g,warp",):
        with pytest.raises(KeyError):
            netcost.profile(bad)
    with pytest.raises(KeyError):
        net(speed=3)
    for fields in ({"latency_ms": -1}, {"latency_dist": "odd"}, {"tail_prob": 2}, {"latency_dist": "pareto", "latency_pareto_alpha": 0}, {"link_jitter": 1, "link_jitter_period_ms": 0}):
        with pytest.raises(ValueError):
            net(**fields)


def test_link_is_shared_fairly():
    assert netmodel.Client(net(link_kbps=8000)).fetch([100_000, 200_000, 300_000, 500_000]).tolist() == pytest.approx([400, 700, 900, 1100])
    capped = netmodel.Client(net(link_kbps=8000, request_kbps=2000)).fetch([100_000] * 2)
    assert capped.tolist() == pytest.approx([400, 400])
    assert netmodel.fair_rates(np.array([10.0, 1.0, np.inf]), 9.0).tolist() == [4.0, 1.0, 4.0]
    assert netmodel.Client(net()).fetch([5, 0]).tolist() == [0, 0]


def test_connections_are_opened_once():
    c = netmodel.Client(net(latency_ms=50, max_concurrent=2, connect_ms=100))
    c.fetch([10] * 4)
    c.fetch([10])
    assert c.now == pytest.approx(250) and c.opened == 2
    c = netmodel.Client(net(latency_ms=100))
    for _ in range(3):
        c.fetch([10] * 3)
    assert c.now == pytest.approx(300) and c.opened == 3
    late_issue = netmodel.Client(net(latency_ms=10)).fetch([1, 1], [0, 500])
    assert late_issue.tolist() == pytest.approx([10, 510])


def test_slow_start():
    one = netmodel.Client(net(latency_ms=100, slow_start=True)).fetch([14_600])[0]
    assert one == pytest.approx(100)
    # 14,600 bytes a round trip, then twice as many each
    assert netmodel.Client(net(latency_ms=100, slow_start=True)).fetch([14_600 * 7])[0] == pytest.approx(300)
    assert netmodel.Client(netmodel.profile("4g,slowstart")).fetch([100_000])[0] > netmodel.Client(netmodel.profile("4g")).fetch([100_000])[0] + 100


def test_link_jitter_depends_on_time_only():
    jittery = netmodel.profile("lan", link_kbps=800, link_jitter=0.5)
    factors = [netmodel.link_factor(jittery, 3, k) for k in range(4000)]
    assert np.mean(factors) == pytest.approx(1, abs=0.05) and factors[7] == netmodel.link_factor(jittery, 3, 7)
    a, b = netmodel.Client(jittery, 1).fetch([50_000])[0], netmodel.Client(jittery, 2).fetch([50_000])[0]
    assert a != b and 200 < a < 1500
    expected, left, t = 1.0, 50_000.0, 1.0
    while left > 0:
        period = int(t // 100)
        rate = 100 * netmodel.link_factor(jittery, 1, period)
        step = min((period + 1) * 100 - t, left / rate)
        left, t = left - rate * step, t + step
    assert a == pytest.approx(t) and expected


@pytest.mark.parametrize(
    ("fields", "mean", "low"),
    [
        ({"latency_dist": "normal", "latency_jitter_ms": 10}, 100, 40), ({"latency_dist": "exponential", "latency_jitter_ms": 30}, 130, 100),
        ({"latency_dist": "lognormal", "latency_sigma": 0.3}, 100 * np.exp(0.045), 20), ({"latency_dist": "pareto", "latency_pareto_alpha": 3}, 150, 100),
        ({"latency_dist": "normal", "latency_jitter_ms": 50, "latency_min_ms": 100, "latency_max_ms": 100, "tail_prob": 0.5, "tail_ms": 1000}, 600, 100),
    ],
)
def test_latencies(fields, mean, low):
    rng = np.random.default_rng(1)
    drawn = [netmodel.sample_latency(net(latency_ms=100, **fields), rng) for _ in range(20_000)]
    assert np.mean(drawn) == pytest.approx(mean, rel=0.05) and min(drawn) >= low


def test_small_cost_functions():
    assert netcost.share_ranges([10] * 12, 6) == [k // 2 for k in range(12)]
    assert max(netcost.share_ranges([1] * 50, 4, 5)) + 1 == 10 and netcost.share_ranges([5, 5], 6) == [0, 1]
    assert netcost.lru([1, 2, 1, 3, 2, 1], 2) == (1, 5) and netcost.lru([1, 2, 3, 1], 2, pinned={1}) == (1, 3)
    assert netcost.lru(list(range(40)), 100, readahead=True)[1] < 8
    assert netcost.cache_budget(1) == 4 << 20 and netcost.cache_budget(1 << 40) == 64 << 20
    rtt, speed = netcost.estimate_link([(50 + b / 100, b) for b in range(0, 6400, 100)])
    assert rtt == pytest.approx(50) and speed == pytest.approx(100)
    # like sizes say nothing of the speed; queued rounds and too few don't count
    assert netcost.estimate_link([(60, 1000)] * 10, rtt=9, bandwidth=50) == (40.0, 50)
    assert netcost.estimate_link([(60, 1000, 9)] * 10, max_req=6, rtt=9, bandwidth=50) == (9, 50) == netcost.estimate_link([(60, 1000)] * 3, rtt=9, bandwidth=50)
    assert netcost.estimate_link([(1, 10)] * 4, bandwidth=1e9)[1] == 1e6
    assert readers.parse_range("bytes=0-4, -3,90-", 100) == [(0, 4), (97, 99), (90, 99)] and readers.parse_range("bytes=5-1", 9) is None
    assert readers.parse_range("Bytes=-0,200-,", 100) == [] and readers.parse_range("bytes=a-", 9) is None and readers.parse_range(None, 9) is None and readers.parse_range("bytes=-", 9) is None
    assert readers.parse_range("bytes=" + ",".join(["0-1"] * 257), 9) is None


def test_requests_of_a_log(spark):
    rows = [(1, 0, 100, 10, 0, 1.0, 5.0, 3), (1, 1, 500, 20, 0, 0.5, 6.0, 3), (1, 2, 900, 5, 0, 2.0, 3.0, None), (1, 3, 0, 7, 0, 2.0, 3.0, None), (1, 4, 8, 7, 1, 9.0, 9.5, 3)]
    log = spark.createDataFrame(rows, "trace_id long, seq long, offset long, length long, round long, start_ms double, end_ms double, req long")
    got = sorted((r["round"], r.idx, r.offset, r.length, r.start_ms, r.end_ms, r.n_ranges) for r in netcost.requests_of_log(log).collect())
    assert got == [(0, 0, 100, 30, 0.5, 6.0, 2), (0, 2, 900, 5, 2.0, 3.0, 1), (0, 3, 0, 7, 2.0, 3.0, 1), (1, 4, 8, 7, 9.0, 9.5, 1)]
    cached = netcost.counters(log.withColumn("cached", F.col("seq") == 4)).first()
    assert (cached.rounds, cached.requests, cached.bytes, cached.hits) == (1, 4, 42, 1)


def test_min_p_sampling():
    rng = np.random.default_rng(1)
    assert min_p_sample(np.array([1.0, 5.0, 2.0]), [], rng, temperature=0) == 1
    assert {min_p_sample(np.array([0.0, 10.0, 9.9]), [], rng) for _ in range(200)} == {1, 2}
    assert min_p_sample(np.array([3.0, 2.0]), [0], rng, temperature=0, penalty=2.0) == 1


def test_snapshot_life(spark, vectors, tmp_path):
    path = f"{tmp_path}/one"
    s = Snapshot.create(vectors.where("vec_id < 100"), path, metric="cosine", store_vectors="f32")
    s.insert(vectors.where("vec_id BETWEEN 100 AND 109"))
    with pytest.raises(ValueError, match="already exists"):
        s.insert(vectors.where("vec_id = 5"))
    s.delete(vectors.where("vec_id IN (3, 104)").select("vec_id"))
    s.delete(spark.createDataFrame([(10**6,)], "vec_id long"))
    s.insert(vectors.where("vec_id = 3"))
    s.update(vectors.where("vec_id = 7").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    rows = {r.vec_id: r.embedding for r in Snapshot.open(spark, path).rows().collect()}
    assert rows.keys() == set(range(110)) - {104} and rows[7][0] == pytest.approx(-vectors.where("vec_id = 7").first().embedding[0])
    assert s.search(vectors.where("vec_id = 9"), 1).first()["id"] == 9 and s.warm().count() == 0
    compact = s.compact(f"{tmp_path}/two")
    assert compact.rows().count() == 109 and discover(spark, [path, f"{tmp_path}/two"]).count() == 2
    assert {r.part for r in sizes(spark, path).collect()} == {"base", "delta", "tombstones", "meta"}
    text = json.loads(spark.read.text(f"{path}/meta").first()[0]) | {"format_version": 99}
    spark.createDataFrame([(json.dumps(text),)], "value string").write.mode("overwrite").text(f"{path}/meta")
    with pytest.raises(ValueError, match="newer"):
        Snapshot.open(spark, path)
    for bad in ({"pq_train": 1}, {"metric": "x"}, {"M": 1}, {"dim": 10, "pq_m": 3}, {"layout": "tree"}):
        with pytest.raises(ValueError):
            check_parameters(bad)


@pytest.mark.parametrize("layout", ["graph", "ivf"])
@pytest.mark.parametrize("form", ["f16", "int8", "none"])
def test_snapshot_indexes(spark, vectors, clustered, tmp_path, layout, form):
    """Built at the first search (or at once without vectors); the base by index, the delta by scanning."""
    s = Snapshot.create(vectors.where("vec_id < 600"), str(tmp_path), layout=layout, store_vectors=form, pq_m=16, nlist=10, nprobe=8, rerank_k=100, ef_search=100)
    s.insert(vectors.where("vec_id BETWEEN 600 AND 649"))
    s.delete(vectors.where("vec_id = 5").select("vec_id"))
    s.update(vectors.where("vec_id = 6").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    x = clustered[:650].copy()
    x[6] = -x[6]
    d = 1 - x @ x.T
    d[:, 5] = 9
    asked = [n for n in range(0, 650, 25)]
    found = lists(Snapshot.open(spark, str(tmp_path)).search(vectors.where("vec_id < 650 AND vec_id % 25 = 0"), 10))
    hits = np.mean([len(set(found[n]) & set(np.argsort(d[n], kind="stable")[:10].tolist())) / 10 for n in asked])
    assert hits >= (0.5 if form == "none" else 0.9)
    assert all(5 not in own for own in found.values()) and found[600][0] == 600
    assert [r["id"] for r in s.search(spark.createDataFrame([(1, x[6].tolist())], "vec_id long, embedding array<double>"), 1).collect()] == [6]
    if form == "none":
        assert s._table("base").columns == ["vec_id"]
        for call in (lambda: s.search(vectors.limit(1), 1, exact=True), lambda: s.compact(f"{tmp_path}/x")):
            with pytest.raises(ValueError):
                call()
    else:
        exact = lists(s.search(vectors.where("vec_id = 0"), 10, exact=True))
        assert len(set(exact[0]) & set(np.argsort(d[0], kind="stable")[:10].tolist())) >= 9
    with pytest.raises(ValueError):
        Snapshot.create(vectors, f"{tmp_path}/y", store_vectors="none")


def test_command_line(spark, vectors, tmp_path, capsys):
    from cairn.__main__ import main

    vectors.where("vec_id < 50").write.parquet(f"{tmp_path}/table")
    main(["build", f"{tmp_path}/table", f"{tmp_path}/index", "--set", "layout=graph", "--set", "pq_m=8"])
    main(["search", f"{tmp_path}/index", f"{tmp_path}/table", f"{tmp_path}/out", "-k", "3"])
    main(["stats", f"{tmp_path}/index"])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 150
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert told["live"] == 50 and told["parameters"]["layout"] == "graph" and "index" in told["parts"]


def ids_of(s):
    return sorted(r.vec_id for r in s.rows().select("vec_id").collect())


def test_streaming_ingestion(spark, vectors, tmp_path):
    from cairn.streaming.ingest import ingest

    s = Snapshot.create(vectors.where("vec_id < 50"), f"{tmp_path}/index")
    vectors.where("vec_id BETWEEN 40 AND 69").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(vectors.schema).parquet(f"{tmp_path}/in")
        ingest(stream, s, f"{tmp_path}/checkpoint").awaitTermination()
    assert ids_of(s) == list(range(70))


def test_a_batch_that_is_run_again_loses_nothing(spark, vectors, tmp_path):
    from cairn.streaming.ingest import ingest

    s = Snapshot.create(vectors.where("vec_id < 10"), f"{tmp_path}/index")

    def feed(low, high, name, checkpoint):
        vectors.where(f"vec_id BETWEEN {low} AND {high}").write.mode("append").parquet(f"{tmp_path}/{name}")
        ingest(spark.readStream.schema(vectors.schema).parquet(f"{tmp_path}/{name}"), s, f"{tmp_path}/{checkpoint}").awaitTermination()

    feed(5, 19, "in", "one")
    for mark in (tmp_path / "one" / "commits").iterdir():
        mark.unlink()
    feed(20, 24, "in", "one")
    assert ids_of(s) == list(range(25))
    # another stream has batches of the same numbers
    feed(20, 29, "other", "two")
    feed(30, 34, "in", "one")
    assert ids_of(s) == list(range(35))


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo \n  \nthree\n")
    assert [tuple(r) for r in readers.read_corpus(spark, str(tmp_path / "a.txt")).orderBy("id").collect()] == [(0, "one"), (1, "two "), (2, "three")]
    (tmp_path / "b.jsonl").write_text('{"text": "x", "i": 1}\n{"text": " "}\n{"text": "y"}\n')
    assert [tuple(r) for r in readers.read_corpus(spark, str(tmp_path / "b.jsonl")).orderBy("id").collect()] == [(0, "x"), (1, "y")]
    np.save(tmp_path / "v.npy", np.arange(12, dtype=np.float16).reshape(6, 2))
    v = readers.read_npy(spark, str(tmp_path / "v.npy"))
    off = spark.createDataFrame([(0, 0, 2), (1, 2, 2), (2, 2, 6)], "doc_id long, start long, stop long")
    got = readers.ragged(v, off).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.v[0]) for r in got] == [(0, 0, 0.0), (0, 1, 2.0), (2, 0, 4.0), (2, 1, 6.0), (2, 2, 8.0), (2, 3, 10.0)]
    for text in ('{"reads": [{"round": 1, "offset": 4, "length": 2}], "rounds": [{"round": 1, "cpu_ms": 3}]}', '[[], [{"offset": 4, "length": 2}]]', '[{"round": 1, "offset": 4, "length": 2}]', '{"round": 1, "offset": 4, "length": 2}\n{"round": 1, "offset": 9, "length": 1}'):
        first = readers.parse_trace(text)["reads"][0]
        assert (first["round"], first["offset"], first["length"]) == (1, 4, 2)
    lines = '{"round": 0, "offset": 4, "length": 2, "t_issue": 7, "file": "a"}\n{"round": 0, "cpu_ms": 3.5}\n'
    told = readers.parse_trace(lines)
    assert told["cpu_ms"] == {0: 3.5} and told["reads"][0] == {"round": 0, "offset": 4, "length": 2, "t_issue_ms": 7.0, "file": "a", "idx": 0}
    (tmp_path / "traces").mkdir()
    (tmp_path / "traces" / "a.json").write_text('{"reads": [{"offset": 0, "length": 8}], "file": "x", "tail_cpu_ms": 5, "rounds": [{"cpu_ms": 1}], "note": "n"}')
    (tmp_path / "traces" / "b.json").write_text(lines)
    reads, rounds = readers.read_traces(spark, str(tmp_path / "traces"))
    assert {r.trace_id: (r.file, r.t_issue_ms) for r in reads.collect()} == {0: ("x", 0.0), 1: ("a", 7.0)}
    assert {r.trace_id: r.ms for r in netcost.simulate(reads, rounds, net(latency_ms=10)).collect()} == {0: 16.0, 1: 20.5}


def test_session(spark, vectors):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox")], "doc_id long, text string")
    s = SearchSession(spark)
    s.register("texts", "fts", docs)
    s.register("near", "exact", vectors)
    s.register("net", "graph", graph.build(vectors.where("vec_id < 100"), quantize.train_pq(vectors, 8, codes=16)))
    assert s.resolve("dense") == "net" and s.resolve("near") == "near" and s.resolve("fts") == "texts"
    assert s.search(spark.createDataFrame([(1, "blue")], "qid long, text string"), "fts", 3).first().doc_id == 2
    assert s.search(vectors.where("vec_id = 4"), "near", 1).first()["id"] == 4 == s.search(vectors.where("vec_id = 4"), "dense", 1).first()["id"]
    with pytest.raises(KeyError):
        s.resolve("late")
    register_functions(spark)
    assert spark.sql("SELECT dot_product(array(1D, 2D), array(3D, 4D)), l2_squared(array(1D), array(3D))").first()[:] == (11.0, 4.0)
