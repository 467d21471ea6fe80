import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from cairn.llm import toxicity as tx


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choices("aeioustnrl", k=rng.randrange(2, 8))) for _ in range(rng.randrange(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "Moron", "stupid"])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    data = rows(800)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in data] + [(None, "", "x", 0.5), (-1, None, "x", 0.5), (0, data[0][1], "x", 0.5)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (5, None), (7, 1)], "doc_id long, toxic int")
    got = tx.score_toxicity(docs, labels).collect()
    assert len(got) == 803
    truth = {i: y for i, _, y in data}
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_labels_of_the_held_out_fold_change_nothing(spark):
    data = rows(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in data]
    a = tx.train(docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"))
    b = tx.train(docs, spark.createDataFrame(other, "doc_id long, toxic int"))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tx.score_toxicity(docs, none).collect()] == [0.5]
    assert tx.score_toxicity(docs.limit(0), none).count() == 0


def test_features_are_a_set_of_folded_text():
    assert np.array_equal(tx.features("Some  WORDS here"), tx.features("some words\nhere"))
    assert len(tx.features("")) == 0 and len(tx.features("ab" * 50_000)) < 10


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_held_out_recall_and_precision(spark):
    """Of the held-out toxic rows of four languages; about 6 % of the toxic labels there are noise."""
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    labels = read("labels")
    got = tx.score_toxicity(read("documents").join(labels.select("doc_id"), "doc_id"), labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    assert len(toxic) == 97 and sum(toxic) >= 83
    assert sum(r.predicted for r in got if r.toxic == 0) <= 2


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_labels_are_noisy():
    """Toxic English texts hold one of ten words; a part of those labelled so holds none."""
    words = "trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron"
    n, none = duckdb.sql(f"SELECT count(*), count(*) FILTER (NOT regexp_matches(lower(coalesce(text, '')), '{words}')) FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) WHERE toxic = 1 AND lang = 'en'").fetchall()[0]
    assert 0.05 < none / n < 0.08
