import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm.common import tokenizer_path
from cairn.llm.packing import pack_power_of_two, piece_lengths, word_memo

PATH = tokenizer_path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["Ünïcode Wörter, ÀÉÎ!!", "it's we'll DON'T x's", "a<|endoftext|>b <|startoftext|>", "K Å İstanbul ΟΔΟΣ ẞ", "é ́a a b\x1cc\x85d", "1234 12a3b", "...,,, ;: '' \"x\" [y]", "日本語テキスト 🙂🙂", "ÿø÷×", "A.b,c"]


def whole(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_memo_equals_library(text):
    assert np.frombuffer(word_memo(PATH).encode(text.encode()), "<u4").tolist() == whole(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAéÉß'.,!<|> \n\t0sdlm")), max_size=40))
def test_memo_equals_library_on_any_text(text):
    assert np.frombuffer(word_memo(PATH).encode(text.encode()), "<u4").tolist() == whole(text)


def test_piece_lengths():
    assert piece_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    assert piece_lengths(1, 2048) == [1] and piece_lengths(2048, 2048) == [2048]
    assert all(sum(piece_lengths(n, 64)) == n for n in range(1, 300))


def test_pieces_rebuild_every_document(spark):
    texts = {1: "the cat sat " * 900, 2: None, 3: "", 4: "Hello, world", 5: "Hello, world", None: "x"}
    rows = [(k, v, "clash", 7) for k, v in texts.items()] + [(4, "Hello, world", "again", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, length int")
    got = pack_power_of_two(docs).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and r.length == 1 << r.bucket and len(r.ids) == 4 * r.length for r in got)
    for key in (1, 2, 3, 5, None):
        pieces = sorted((r for r in got if r.doc_id == key), key=lambda r: r.start)
        ids = b"".join(bytes(r.ids) for r in pieces)
        assert np.frombuffer(ids, "<u4").tolist() == whole(texts[key] or "") + [1]
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        assert {r.doc_tokens for r in pieces} == {len(ids) // 4}
    assert sum(r.length for r in got if r.doc_id == 4) == 2 * (len(whole("Hello, world")) + 1)
    assert pack_power_of_two(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack_power_of_two(docs, limit=1000)


def test_crc_is_of_little_endian_ids(spark):
    from cairn.llm.packing import digests

    docs = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    rows = digests(pack_power_of_two(docs)).collect()
    ids = whole("abc def") + [1]
    assert [r.ids_crc32 for r in sorted(rows, key=lambda r: r.start)] == [zlib.crc32(np.array(ids[:2], "<u4").tobytes()), zlib.crc32(np.array(ids[2:], "<u4").tobytes())]
