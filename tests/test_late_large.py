"""Late queries give what their SQL gives on more than 50,000 tokens."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cairn.plans import late_queries
from tests.test_oracles import table

NAMES = ["residual_decode", "late_exact", "plaid_codes", "plaid_ivf", "warp_options", "warp_rerank", "warp_search", "warp_stoplist", "warp_two_level"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """50,400 tokens, of which two documents ask (their numbers are divisible by 50)."""
    rng = np.random.default_rng(8)
    doc = np.arange(5_040)
    doc = np.where(doc < 2, doc * 50, doc // 49 * 50 + doc % 49 + 1)
    label = rng.integers(10, size=len(doc) * 10)
    x = rng.normal(size=(10, 64))[label] + rng.normal(size=(len(label), 64)) * rng.choice([0.5, 2.0], size=(len(label), 1))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    out = tmp_path_factory.mktemp("many")
    ids = (doc[:, None] * 10 + np.arange(10)).ravel()
    assert len(set(ids)) == len(ids)
    t = pa.table({"vec_id": ids, "embedding": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * 64, x.ravel()), "label": pa.array(label, pa.int32())})
    pq.write_table(t, out / "embeddings.parquet", row_group_size=5_000)
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    df, sql = late_queries.QUERIES[name](spark, folder), late_queries.SQL[name]
    if name == "residual_decode":  # 3 million rows: some of them
        df, sql = df.where("doc_id % 100 = 7"), f"SELECT * FROM ({sql}) WHERE doc_id % 100 = 7"
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    assert table(df.collect(), df.columns) == table(got.fetchall(), columns)
