"""Trained indexes find 0.9 of the neighbours where a fixed number of candidates does not."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cairn.operators import ivf, quantize
from cairn.plans import vector_queries

NAMES = ["pq_trained", "opq_trained", "ivf_trained"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    x = np.random.default_rng(9).normal(size=(8_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    out = tmp_path_factory.mktemp("random")
    t = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * 64, x.ravel()), "label": pa.array(np.arange(len(x)) % 10, pa.int32())})
    pq.write_table(t, out / "embeddings.parquet", row_group_size=2_000)
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_query_finds_the_neighbours(spark, folder, name):
    row = vector_queries.QUERIES[name](spark, folder).first()
    assert (row.n_queries, row.recalled) == (160, True)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("residual", [True, False])
def test_share_of_neighbours(spark, metric, residual):
    x = np.random.default_rng(10).normal(size=(3_000, 16))
    df = spark.createDataFrame([(n, v) for n, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3)
    c = ivf.train_centroids(df, 8, 5)
    book = quantize.train_pq(ivf.residuals(df, c) if residual else df, 2, codes=8)
    q = x[:40]
    true = ((q[:, None] - x[None]) ** 2).sum(2) if metric == "l2" else 1 - q @ x.T
    want = np.argsort(np.round(true, 6), axis=1, kind="stable")[:, :10]
    index, queries = ivf.build(df, c, book, metric, residual), df.where("vec_id < 40")

    def found(share):
        got = {(r.qid, r.id) for r in ivf.search(index, queries, nprobe=8, rerank_k=20, share=share).collect()}
        assert len(got) == 400
        return np.mean([(n, i) in got for n, own in enumerate(want.tolist()) for i in own])

    assert found(0.0) < 0.9 <= found(0.95)
    assert ivf.search(index, queries.where("vec_id < 0"), share=0.95).count() == 0
