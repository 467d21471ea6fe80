import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import near_dedup, secrets, toxicity
from cairn.llm.common import tokenizer_path
from cairn.llm.packing import piece_lengths


def corpus():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "alpha beta gamma delta omega sigma".split() for b in "ing ed er tion ly".split()]
    rows = []
    for i in range(220):
        text = [rng.choice(words) for _ in range(rng.randrange(15, 60))]
        if i % 5 == 1:
            text[3] = text[9] = "idiot"
        rows.append([i, " ".join(text)])
    rows[50][1] = rows[40][1]
    rows[60][1] = rows[70][1] = rows[10][1] + " " + "extra"
    rows[80][1] += ' token = "0123456789abcdef0123456789abcdef01234567" end'
    rows += [[500, None], [501, ""], [502, "short"], [503, "short"]]
    rows += [[80, rows[80][1]]]
    return [(i, t, "en", "src", len(t or "")) for i, t in rows]


def brute(spark, docs, rows, labels):
    model = toxicity.train(docs, labels)
    rows = [r for r in rows if model.score(r[1] or "") < 0.5]
    last = {}
    for r in rows:
        last[r[1] or ""] = max(r[0], last.get(r[1] or "", -1))
    rows = {(r[0], r[1] or ""): r for r in rows if last[r[1] or ""] == r[0]}.values()
    sets = {r[0]: near_dedup.shingle_set((r[1] or "").encode(), 5) for r in rows}
    own = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and own[j] < own[i] and 100 * len(a & b) >= 80 * len(a | b):
                    own[i] = own[j]
                    changed = True
    rows = [r for r in rows if own[r[0]] == r[0]]
    enc = secrets.encoding(tokenizer_path("byte_bpe_50k.tiktoken"))
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = []
    for i, text, *_ in rows:
        text = secrets.redact(text or "", secrets.find_secrets(text or "", enc))
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        start = 0
        for n in piece_lengths(len(ids), 2048):
            out.append((i, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)))
            start += n
    return sorted(out)


def test_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(0, 200)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == brute(spark, docs, rows, labels)
    assert len({r.sequence_id for r in got}) == len(got)
    ids = {r.doc_id for r in got}
    assert not any(i % 5 == 1 for i in ids if i < 220) and 40 not in ids and 50 in ids and 503 in ids and 502 not in ids


def test_stages_keep_the_columns(spark, tmp_path):
    rows = corpus()[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema == docs.schema
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
