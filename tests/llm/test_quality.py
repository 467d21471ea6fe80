import random

import numpy as np
import pytest

from cairn.llm import quality as ql

SPACE = " \t\n\r\x0b\x0c"


def brute(text):
    words, lines = [], text.split("\n")
    for c in SPACE:
        text = text.replace(c, "\0")
    words = [w for w in text.split("\0") if w]
    windows = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    again = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    with_word = [x for x in lines if x.strip(SPACE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(with_word) - len(set(with_word)), len(again)


def texts():
    rng = random.Random(4)
    fixed = ["", " \n\t ", "a", "ä ö\x1cü\xa0ß", "x\n\nx\n x\nx", "1 2 3 4 5 1 2 3 4 5", "## $$ <b>|&", "a b c d e " * 5000, "\x85 a b"]
    return fixed + [" ".join(rng.choices("abcd", k=rng.randrange(5, 60))) for _ in range(60)] + ["\n".join(rng.choices(["l one", "l two", ""], k=9)) for _ in range(10)]


@pytest.mark.parametrize("text", texts())
def test_base_counts(text):
    words, *rest = ql.base_counts(text.encode())
    assert (len(words), *rest) == brute(text)


def test_repeated_words_of_large_vocabularies():
    rng = random.Random(2)
    words = [f"w{rng.randrange(40_000)}" for _ in range(60_000)]
    words += words[100:140]
    assert ql.repeated_words([w.encode() for w in words]) == brute(" ".join(words))[4] == 80


def corpus(n=400):
    rng = random.Random(7)
    good, junk = [f"g{k}" for k in range(300)], [f"j{k}#" for k in range(300)]
    return [(i, " ".join(rng.choices(junk if i % 5 == 0 else good, k=rng.randrange(12, 80)))) for i in range(n)]


def test_scores_and_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in rows] + [(None, None, "c", 0), (1000, "a b c d e " * 9, "c", 0), (0, rows[0][1], "c", 0)], "doc_id long, text string, kept string, score int")
    trusted = spark.createDataFrame([(i,) for i, _ in rows if i % 5 and i % 2] + [(None,), (1,), (77_777,)], "doc_id long")
    got = ql.quality_rules(docs, trusted).collect()
    assert len(got) == len(rows) + 3
    everything = [t for _, t in rows] + ["a b c d e " * 9, rows[0][1]]
    raw, target = np.ones(ql.BUCKETS), np.ones(ql.BUCKETS)
    for t in everything:
        np.add.at(raw, ql.ngram_buckets(t.encode().split()), 1)
    for i, t in rows:
        if i % 5 and i % 2:
            np.add.at(target, ql.ngram_buckets(t.encode().split()), 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for r in got:
        text = dict(rows).get(r.doc_id, "a b c d e " * 9 if r.doc_id == 1000 else "")
        n, chars, symbols, lines, repeated = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        failed = n < 10 or 100 * repeated > 20 * n
        want = ratio[ql.ngram_buckets(text.encode().split())].mean() if n else 0
        assert r.base_failed == failed and abs(r.score - want) < 1e-9 and r.kept == (not failed and want >= ql.THRESHOLD)
    assert not any(r.kept for r in got if r.doc_id is not None and r.doc_id % 5 == 0)
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id % 5 and r.doc_id % 2)


def test_without_trusted_rows_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert [(r.score, r.kept) for r in ql.quality_rules(docs, none).collect()] == [(0.0, True)]
    assert ql.quality_rules(docs.limit(0), none).count() == 0


def test_many_trusted_rows_move_their_texts_only(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    trusted = docs.where("doc_id % 5 != 0 AND doc_id % 2 = 1").select("doc_id")
    few = ql.fit_ratio(docs, trusted)
    monkeypatch.setattr(ql, "BROADCAST_ROWS", 10)
    assert np.array_equal(few, ql.fit_ratio(docs, trusted))


def test_calibration(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    trusted = docs.where("doc_id % 5 != 0 AND doc_id % 2 = 1").select("doc_id")
    scored = ql.quality_rules(docs, trusted)
    limit = ql.threshold_for(scored, trusted, 0.9)
    scores = [r.score for r in scored.join(trusted, "doc_id").where("NOT base_failed").collect()]
    assert abs(np.mean([s >= limit for s in scores]) - 0.9) < 0.02
    assert ql.threshold_for(scored, trusted.limit(0)) == ql.THRESHOLD
