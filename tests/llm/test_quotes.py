import random

from cairn.llm import common
from cairn.llm import quotes as qt

A = "Hello all,\nthe build is broken since Monday."
MESSAGES = [
    (1, 0, "user", A),
    (1, 1, "user", "> the build is  BROKEN since monday.\nWorks for me.\nTry again."),
    (1, 2, "user", ">> the build is broken since Monday.\n> Works for me.\nNot here."),
    (1, 3, "user", "Unrelated"),
    (1, 4, "user", "> > the build is broken since Monday.\n\nold news"),
    (1, 5, "user", "> nobody said this\nreally?"),
    (2, 0, "user", "Common opening"),
    (3, 0, "user", "Common opening"),
    (3, 2, "user", "> Common opening\nyes"),
    (4, 7, "user", "> Works for me.\nfrom elsewhere"),
    (5, 0, None, None),
    (5, 2000, "user", "late"),
    (5, 4000, "user", ""),
    (None, 0, "user", "> Common opening"),
    (6, None, "user", "x"),
]


def table(spark, rows=MESSAGES):
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, body string")


def test_links_and_bodies(spark):
    got = {(r.conv_id, r.turn): r for r in qt.link_quotes(table(spark)).collect()}
    assert len(got) == len(MESSAGES)
    parent = {k: (r.linked, r.parent_conv, r.parent_turn, r.root_conv, r.root_turn, r.depth) for k, r in got.items()}
    assert parent[1, 0] == (False, None, None, 1, 0, 0)
    assert parent[1, 1] == (True, 1, 0, 1, 0, 1)
    assert parent[1, 2] == (True, 1, 1, 1, 0, 2)
    assert parent[1, 3] == (False, 1, 2, 1, 0, 3)
    assert parent[1, 4] == (True, 1, 0, 1, 0, 1)
    assert parent[1, 5] == (False, 1, 4, 1, 0, 2)
    assert parent[3, 2] == (True, 3, 0, 3, 0, 1)
    assert parent[4, 7] == (True, 1, 1, 1, 0, 2)
    assert parent[5, 2000] == (False, 5, 0, 5, 0, 1) and parent[5, 4000][2] == 2000
    order = sorted((k for k in got if got[k].root_conv == 1), key=lambda k: got[k].position)
    assert order == [(1, 0), (1, 1), (1, 2), (1, 3), (4, 7), (1, 4), (1, 5)] and [got[k].position for k in order] == list(range(7))
    assert parent[None, 0][:3] == (False, None, None) and parent[6, None][:3] == (False, None, None)
    assert got[1, 1].body == "Works for me.\nTry again." and got[1, 2].n_quotes == 2 and got[1, 2].body == "Not here." and got[5, 0].body == ""


def test_all_earlier_sayers_are_candidates(spark):
    rows = [(1, 1, "u", "Thanks"), (1, 2, "u", "See below"), (1, 3, "u", "Thanks\nSee below\nPlan"), (1, 4, "u", "> Thanks\n> See below\nok")]
    rows += [(2, 1, "u", "Again"), (2, 5, "u", "Again"), (2, 6, "u", "> Again\nyes"), (2, 3000, "u", "> Again\nlate"), (2, 3001, "u", "Again")]
    rows += [(3, 4, "u", "> Elsewhere\nElsewhere"), (3, 5, "u", "Elsewhere"), (4, 2, "u", "Elsewhere"), (5, 1, "u", "Elsewhere")]
    got = {(r.conv_id, r.turn): (r.linked, r.parent_conv, r.parent_turn) for r in qt.link_quotes(table(spark, rows)).collect()}
    assert got[1, 4] == (True, 1, 3)
    assert got[2, 6] == (True, 2, 5) and got[2, 3000] == (True, 2, 5)
    assert got[3, 4] == (True, 4, 2)


def brute(rows):
    """(conv, turn) -> (linked, parent, root, depth, position), by plain search."""
    said, quoted = {}, {}
    for conv, turn, _, text in rows:
        for level, x in qt.sayings(text or "")[1]:
            (quoted.setdefault((conv, turn), set()).add((level, x)) if level else said.setdefault((conv, turn), set()).add(x))
    keys = sorted({r[:2] for r in rows})
    parent, linked = {}, set()
    for k in keys:
        earlier = [o for o in keys if o[0] == k[0] and o[1] < k[1]]
        parent[k] = earlier[-1] if earlier else None
        for level in sorted({a for a, _ in quoted.get(k, ())}):
            asked = [x for a, x in quoted[k] if a == level]
            votes = {}
            for x in asked:
                sayers = [o for o in earlier if x in said.get(o, ())]
                if sayers:
                    votes[sayers[-1]] = votes.get(sayers[-1], 0) + 1
            for x in asked if not votes else ():
                sayers = [o for o in keys if o[0] != k[0] and x in said.get(o, ())]
                if sayers:
                    votes[sayers[0]] = votes.get(sayers[0], 0) + 1
            if votes:
                parent[k] = max(votes, key=lambda o: (votes[o], o[1], -o[0]))
                linked.add(k)
                break
    for k in keys:
        path = []
        while k is not None and k not in path:
            path.append(k)
            k = parent[k]
        if k is not None:
            parent[min(path[path.index(k) :])] = None
    out = {}

    def visit(k, root, depth):
        out[k] = (k in linked, parent[k], root, depth, sum(v[2] == root for v in out.values()))
        for c in sorted((c for c in keys if parent[c] == k), key=lambda c: (c[0] != k[0], c)):
            visit(c, root, depth + 1)

    for k in keys:
        if parent[k] is None:
            visit(k, k, 0)
    return out


def found(spark, rows):
    got = qt.link_quotes(table(spark, rows)).collect()
    return {(r.conv_id, r.turn): (r.linked, None if r.parent_turn is None else (r.parent_conv, r.parent_turn), (r.root_conv, r.root_turn), r.depth, r.position) for r in got}


def test_circles(spark):
    rows = [(1, 0, "u", "alpha\n> beta"), (2, 0, "u", "beta\n> alpha"), (2, 1, "u", "next"), (3, 0, "u", "gamma\n> next")]
    got = found(spark, rows)
    assert got == brute(rows)
    assert got[1, 0] == (True, None, (1, 0), 0, 0) and got[2, 0] == (True, (1, 0), (1, 0), 1, 1) and got[3, 0] == (True, (2, 1), (1, 0), 3, 3)


def test_random_conversations(spark):
    """Quotes of earlier, later, common and foreign lines, gaps and circles, against plain search."""
    rng = random.Random(3)
    for size in (12, 60):
        lines = [f"line {k}" for k in range(size)] + ["ok"] * 4
        rows = []
        for conv in range(size // 3):
            for turn in range(rng.randrange(1, 9)):
                quote = [f"{'>' * rng.randrange(1, 3)} {rng.choice(lines)}" for _ in range(rng.randrange(0, 3))]
                rows.append((conv, turn * rng.choice((1, 700)), "u", "\n".join([*quote, *rng.choices(lines, k=rng.randrange(1, 3))])))
        rows = list({r[:2]: r for r in rows}.values())
        assert found(spark, rows) == brute(rows)


def test_hot_lines_and_targets(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 5)
    rows = [(c, t, "u", f"> ok\nfine {c}" if t % 2 else "ok") for c in range(20) for t in range(4)] + [(c, 0, "u", "> hello\nyes") for c in range(100, 140)] + [(99, 0, "u", "hello")]
    assert found(spark, rows) == brute(rows)


def test_reply_order(spark):
    got = qt.in_reply_order(qt.link_quotes(table(spark))).collect()
    keyed = [(r.root_conv, r.root_turn, r.position) for r in got if r.root_conv is not None and r.root_turn is not None]
    assert keyed == sorted(keyed)


def test_hashes_are_compared(spark, monkeypatch):
    links = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 2, 0)], "conv_id long, turn long, to_conv long, to_turn long")
    keyed = spark.createDataFrame([(1, 0, "a b", None), (1, 1, "x", "> A  b\nx"), (2, 0, "other", None), (2, 1, "x", "> A  b\nx")], "conv_id long, turn long, body string, text string")
    assert [r.conv_id for r in qt._compared(links, keyed).collect()] == [1]


def test_chain_of_replies(spark):
    rows = [(1, k, "u", (f"> message {k - 1}\n" if k else "") + f"message {k}") for k in range(40)]
    got = qt.link_quotes(table(spark, rows)).collect()
    assert {(r.turn, r.depth, r.root_turn) for r in got} == {(k, k, 0) for k in range(40)}


def test_repeated_rows_and_empty_table(spark):
    rows = [MESSAGES[0], MESSAGES[1], MESSAGES[1]]
    got = qt.link_quotes(table(spark, rows)).collect()
    assert len(got) == 3 and sum(r.linked for r in got) == 2
    assert qt.link_quotes(table(spark, [])).count() == 0


def test_levels():
    assert qt.levels("> > a\n>>b\n c\n >d") == [(2, "a"), (2, "b"), (0, " c"), (1, "d")]
    assert len(qt.parse("> q\n" * 30_000 + "end")[1]) == 3
