import random

import numpy as np
import pytest

from cairn.llm import near_dedup as nd
from cairn.llm.components import connected_components


def brute(rows, width, percent=80):
    sets = [(i, nd.shingle_set((t or "").encode(), width)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(2000)]
    texts = ["", None, "One", "one", "two words", "a b c d e", "a b c d e f", " \t\n"]
    passage = rng.choices(vocabulary, k=60)
    for size in (30, 120, 400):
        for group in range(6):
            base = rng.choices(vocabulary, k=size)
            texts += [edited(base, rng.randrange(1 + size // 12), rng) for _ in range(1 + 3 * group)]
    texts += [" ".join(rng.choices(vocabulary, k=rng.choice((10, 25, 60))) + passage) for _ in range(60)]
    texts += [texts[-1], texts[-1].upper()]
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(spark, width):
    rows = corpus(width)
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, sig string, mark int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_dedup(docs, width=width).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows, width).items()}


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "SHORT", 3)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    far = [edited(base, 22, rng) for _ in range(40)]
    rows = list(enumerate(far))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(docs, width=2).collect()}
    assert got == brute(rows, 2)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "A B C")], "doc_id long, text string")
    got = sorted(map(tuple, nd.near_dedup(docs, width=2).drop("text_hash").collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False)], key=str)
    assert nd.near_dedup(docs.limit(0), width=2).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    seen = []
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = x[:900], np.concatenate([x[100:]])
        seen.append((nd.signature(a) == nd.signature(b)).mean())
    assert abs(np.mean(seen) - 0.8) < 0.02 and min(seen) * nd.COORDINATES >= nd.MATCHES


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, k) for k in range(301, 400)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_components_of_hubs_and_chains(spark, monkeypatch):
    from cairn.llm import common, components

    monkeypatch.setattr(components, "FEW_EDGES", 0)
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    edges = [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 230)] + [(159, 99), (5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 99 for k in [99, 100, *range(101, 160)]} | {k: 200 for k in range(200, 231)}
