import random
import re

from cairn.llm import licenses as lc

SHINGLES = lc.template_shingles(lc.TEMPLATES)


def brute(text):
    """license -> (windows, first word, shingles found), over all windows and templates."""
    words = re.findall(lc.WORD, text.lower())
    out = {}
    for w in range(0, len(words) // lc.STRIDE + 1):
        part = words[w * lc.STRIDE : w * lc.STRIDE + lc.WINDOW]
        own = {" ".join(part[k : k + 3]) for k in range(len(part) - 2)}
        for name, wanted in SHINGLES.items():
            n = len(own & set(wanted))
            if 100 * n >= lc.PERCENT * len(wanted):
                old = out.get(name, (0, w * lc.STRIDE, 0))
                out[name] = (old[0] + 1, old[1], max(old[2], n))
    return out


def corpus():
    rng = random.Random(9)
    filler = ["licensed", "under", "the", "license", "version", "alpha", "beta", "gamma", "reserved", "software"]
    out = ["", None, "All rights reserved.", "ALL  RIGHTS\nRESERVED", "rights reserved all", "Licensed under the Apache License"]
    for name, text in lc.TEMPLATES.items():
        for _ in range(3):
            words = text.split()
            if rng.random() < 0.5 and len(words) > 10:
                words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(rng.choices(filler, k=rng.randrange(0, 150))) + " " + " ".join(words) + " " + " ".join(rng.choices(filler, k=rng.randrange(0, 90))))
    out.append(" ".join(lc.TEMPLATES.values()))
    out.append("word " * 30_000 + lc.TEMPLATES["MIT"])
    return out + [" ".join(rng.choices(filler, k=200)) for _ in range(20)]


def test_against_all_windows_and_templates(spark):
    rows = list(enumerate(corpus()))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(2, rows[2][1], "x", 1), (None, "All rights reserved", "x", 1)], "doc_id long, text string, license_id string, window int")
    got = {(r.doc_id, r.license_id): (r.n_windows, r.first_word, r.shingles_found) for r in lc.scan_licenses(docs).collect()}
    want = {(i, n): v for i, t in rows for n, v in brute(t or "").items()} | {(None, "All-rights-reserved"): (1, 0, 1)}
    assert got == want
    assert all(r.shingles_all == len(SHINGLES[r.license_id]) for r in lc.scan_licenses(docs).collect())


def test_short_licenses_beside_notices(spark):
    notices = [lc.TEMPLATES[n] for n in ("MIT-notice", "GPL-notice", "Apache-notice", "BSD-notice", "MPL-2.0")]
    rows = [f"Copyright X. {short} {one}" for short in lc.TEMPLATES.values() for one in notices]
    rows += [f"Copyright X. {short} {one} {other}" for short in lc.TEMPLATES.values() for one in notices for other in notices if one != other]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r.doc_id, r.license_id): (r.n_windows, r.first_word, r.shingles_found) for r in lc.scan_licenses(docs).collect()}
    assert got == {(i, n): v for i, t in enumerate(rows) for n, v in brute(t).items()}
    assert (0, "Apache-2.0") in got and all((i, "All-rights-reserved") in got for i, t in enumerate(rows) if "All rights" in t)


def test_whole_texts(spark):
    rng = random.Random(4)
    texts = lc.whole_texts()
    shingles = lc.template_shingles(texts)
    filler = lambda n: " ".join(rng.choices(["alpha", "license", "software", "program", "of", "the"], k=n))
    rows = [f"{filler(rng.randrange(200))} {t} {filler(rng.randrange(90))}" for t in texts.values()]
    words = [t.split() for t in texts.values()]
    rows += [" ".join(w if rng.random() > 0.06 else "changed" for w in ws) for ws in words]
    rows += [" ".join(ws[: len(ws) // 2]) for ws in words] + [" ".join(ws[: len(ws) // 2] + ["x"] * 6000 + ws[len(ws) // 2 :]) for ws in words]
    rows += [texts["MIT-text"] + " x" * 40 + " " + texts["MIT-text"], "", None, lc.TEMPLATES["MIT-notice"]]
    want = {}
    for i, text in enumerate(rows):
        own = re.findall(lc.WORD, (text or "").lower())
        at = [" ".join(own[k : k + 3]) for k in range(len(own) - 2)]
        for name, wanted in shingles.items():
            wanted, size = set(wanted), lc.strides(texts[name]) * lc.STRIDE
            if 100 * len(wanted & set(at)) < lc.PERCENT * len(wanted):
                continue
            held = [(w, len(wanted & set(at[w * lc.STRIDE : w * lc.STRIDE + size - 2]))) for w in range(len(own) // lc.STRIDE + 1)]
            held = [(w, n) for w, n in held if 100 * n >= lc.PERCENT * len(wanted)]
            if held:
                want[i, name] = (len(held), held[0][0] * lc.STRIDE, max(n for _, n in held))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r.doc_id, r.license_id): (r.n_windows, r.first_word, r.shingles_found) for r in lc.scan_licenses(docs, templates=texts).collect()}
    assert got == want and all((i, n) in got for i, n in enumerate(texts))


def test_query_scans_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, lc.whole_texts()["ISC-text"])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.license_id for r in lc.op7_license_scan(spark, str(tmp_path)).collect()} == {"ISC-text"}


def test_empty_table(spark):
    assert lc.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_leave_too_little():
    for own in SHINGLES.values():
        chosen = lc.anchors(own)
        left = [s for s in own if not chosen & set(s.split())]
        assert 100 * len(left) < lc.PERCENT * len(own)
