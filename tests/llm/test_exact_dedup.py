from collections import defaultdict
from hashlib import sha256

import pytest

from cairn.llm import exact_dedup as ed
from cairn.llm.exact_dedup import DigestIndex, build_filter, build_index, drop_copies, exact_dedup, filter_bits, fingerprints, through_filter

ROWS = [(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, "", None), (5, "b" * 50_000, "x"), (6, "b" * 50_000 + " ", "x"), (7, "A", "q"), (7, "A", "q"), (None, "n", "n"), (9, "a", "w")]
SCHEMA = "doc_id long, text string, digest string"


@pytest.mark.parametrize("keep", ["min", "max"])
def test_against_brute_force(spark, keep):
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    pick = max if keep == "max" else min
    want = []
    for i, t, _ in ROWS:
        ids = [x for x in groups[t or ""] if x is not None]
        k = pick(ids) if ids else None
        want.append((i, k, len(groups[t or ""]), i == k, sha256((t or "").encode()).hexdigest()))
    got = exact_dedup(spark.createDataFrame(ROWS, SCHEMA), keep=keep).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_dropping_leaves_one_of_each(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.text or "")[:3] + str(r.doc_id) for r in left.collect()) == sorted(["a1", "3", "bbb5", "bbb6", "A7", "nNone"])


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_text_is_equal(spark):
    assert all(r.kept and r.group_size == 1 for r in exact_dedup(spark.createDataFrame([(i, str(i), "") for i in range(50)], SCHEMA)).collect())


def test_filter_passes_all_its_keys_and_few_others(spark):
    own = fingerprints(spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS text"), "text", "doc_id")
    other = fingerprints(spark.range(10_000, 20_000).selectExpr("id AS doc_id", "cast(id AS string) AS text"), "text", "doc_id")
    bits = filter_bits(3000)
    bitmaps = build_filter(own, bits)
    assert through_filter(own, bitmaps, bits).count() == 3000
    assert through_filter(other, bitmaps, bits).count() < 1500


def test_index_grows_and_answers(spark):
    make = lambda a, b: fingerprints(spark.range(a, b).selectExpr("id AS doc_id", "cast(id % 100 AS string) AS text"), "text", "doc_id")
    index = DigestIndex(4).flush(make(50, 80)).flush(make(100, 180))
    assert [r.n_rows for r in index.runs] == [30, 80]
    for now in (index, index.compact()):
        assert {r.keep for r in now.lookup(make(260, 262)).collect()} == {60, 61}
        assert now.lookup(make(95, 97)).count() == 0
    assert index.compact().base.count() == 80
    assert {(r.n, r.keep) for r in index.compact().base.where("n > 1").collect()} == {(2, k) for k in range(50, 80)}
    assert DigestIndex(4).lookup(make(1, 5)).count() == 0


def test_runs_are_sorted_and_merge_without_an_exchange(spark):
    entries = fingerprints(spark.range(5000).selectExpr("id AS doc_id", "cast(id % 900 AS string) AS text"), "text", "doc_id")
    index = DigestIndex(4).flush(entries.where("id < 2500")).flush(entries.where("id >= 2500"))
    for run in (*index.runs, *index.compact().runs):
        parts = run.rows.select("digest").rdd.glom().collect()
        assert len(parts) <= 4 and all([bytes(r.digest) for r in p] == sorted(bytes(r.digest) for r in p) for p in parts)
    a, b = (r.rows for r in index.runs)
    plan = a.hint("merge").join(b.withColumnRenamed("n", "m"), "digest", "full")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_any_number_of_memtables(spark, rows):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    want = sorted(map(tuple, exact_dedup(docs).collect()), key=str)
    assert sorted(map(tuple, exact_dedup(docs, memtable_rows=rows).collect()), key=str) == want
    assert len(build_index(fingerprints(docs, "text", "doc_id"), memtable_rows=rows).runs) == 1


def test_full_filters_stay_right(spark, monkeypatch):
    monkeypatch.setattr(ed, "MAX_FILTER_BITS", ed.BITMAP_BITS)
    docs = spark.range(40_000).selectExpr("id AS doc_id", "cast(id div 2 AS string) AS text")
    assert exact_dedup(docs).where("kept AND group_size = 2").count() == 20_000
