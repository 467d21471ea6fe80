from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import bpe
from cairn.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = bpe.pieces_of(PATH)
WORDS = ["the", " the", " thing", "thing", "ing", ".", ",", " über", "\n", " ", "'s"]
LEXICON = bpe.Lexicon(bpe.compile_lexicon((w.encode(), PIECES.merge(w.encode())) for w in WORDS))


def check(text):
    ids = bpe.encode_batch([text], PIECES, LEXICON)[0]
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert PIECES.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "the thing's  über\n\n thing.", "a<|endoftext|> <|endoftext|>b", "x \x1c y\x85z\xa0 　w", "日本 🙂 é", "  lead", "trail  \n", "I'll DON'T 12ab!!", "a​ b"])
def test_equals_library(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("theing 's.,\n\t \xa0\x1cÜ1<|")), max_size=40))
def test_equals_library_on_any_text(text):
    check(text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), max_size=3), max_size=30), st.lists(st.binary(max_size=6), max_size=20))
def test_transducer_is_a_map(entries, others):
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries.items()))
    asked = [*entries, *others]
    for word, n in zip(asked, lexicon.numbers(asked).tolist(), strict=True):
        assert (n >= 0) == (word in entries)
        if n >= 0:
            assert np.frombuffer(lexicon.ids_of(n), "<u4").tolist() == entries[word]


def test_suffixes_are_shared():
    words = [a + b for a in ("x", "y", "z") for b in ("ating", "ated", "ation")]
    lexicon = bpe.Lexicon(bpe.compile_lexicon((w.encode(), [k]) for k, w in enumerate(words)))
    # start, after x|y|z, a, t, i, e, in, io, end
    assert len(lexicon.final) == 9


def test_table(spark):
    texts = {1: "the thing " * 3000, 2: None, 3: "", 4: "the thing", 5: "Zwölf<|endoftext|>", None: "a"}
    docs = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()] + [(4, "the thing", "c")], "doc_id long, text string, ids string")
    got = bpe.bpe_round_trip(docs).collect()
    assert len(got) == 7
    for r in got:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.decoded == (texts[r.doc_id] or "") and r.n_tokens == len(r.ids) // 4
    assert bpe.bpe_round_trip(docs.limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    spark.createDataFrame([(1, "Ab c"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe.op5_bpe_transducer(spark, str(tmp_path)).collect()}
    ids = LIBRARY.encode("Ab c", add_special_tokens=False).ids
    assert got[1].ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[1].decoded_sha256 == sha256(b"Ab c").hexdigest()
    assert got[2].ids_sha256 == sha256(b"").hexdigest() and got[2].n_tokens == 0
