"""Packing by power-of-two decomposition.

A document of n tokens is cut into ``n // limit`` pieces of the limit and one piece for every set
bit of the rest, longest first. Every piece is a sequence by itself whose length is a power of two,
so no sequence crosses documents and none is padded; sequences of equal length form a bucket, from
which batches of equal shape are drawn. Nothing has to meet in one place, hence no exchange at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tokenizer_path

#: Words that a worker remembers at most.
MEMO_WORDS = 400_000
#: A word whose pieces are plain: Latin letters, then ASCII marks that start no contraction or special token.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,!?;:%$&*#]*)")
SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int"

_memo: dict[str, "WordMemo"] = {}


class WordMemo(dict):
    """Word bytes to little-endian 32-bit ids. Encoding never looks across ASCII white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.marks: dict[str, bytes] = {"": b""}
        #: The visible character that stands for each byte, taken from the tokenizer itself.
        self.shown = [self._shown(b) for b in range(256)]

    def _shown(self, b: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        if b < 128:
            return ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]
        # two-byte characters show their lead and continuation bytes
        lead, follow = (b, 0x80) if b >= 0xC2 else (0xC2, b)
        if b in (0xC0, 0xC1) or b >= 0xE0:
            return ""  # never reached: PLAIN words hold one- and two-byte characters only
        s = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(bytes([lead, follow]).decode())[0][0]
        return s[0] if b >= 0xC2 else s[1]

    def _whole(self, s: str) -> bytes:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        s = word.decode()
        if m := PLAIN.fullmatch(s):
            stem, mark = m.groups()
            if mark not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {"": b""}
                self.marks[mark] = self._whole(mark)
            out = self.marks[mark]
            if stem:
                low = stem.lower()
                shown = low if low.isascii() else "".join(self.shown[b] for b in low.encode())
                out = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes() + out
        else:
            out = self._whole(s)
        if len(word) <= 64:
            self[word] = out
        return out

    def encode(self, text: bytes) -> bytes:
        if len(self) > MEMO_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


def word_memo(path: str) -> WordMemo:
    if path not in _memo:
        _memo[path] = WordMemo(path)
    return _memo[path]


def piece_lengths(n: int, limit: int) -> list[int]:
    """Lengths of the pieces of n tokens, longest first; ``limit`` is a power of two."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_power_of_two(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: int = 2048, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id``, ``offset`` (always 0) and ``bucket`` (log2 of the length).

    A null or empty text has the end id alone and so one piece. Texts of any length are cut whole.
    Rows that repeat an id or a text are packed as documents of their own, and null ids are
    carried. Other columns are ignored; an empty table gives an empty table. ``sequence_id`` is
    unique over the result and depends on how the input is dealt over tasks, not on its ids.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    path = vocabulary or tokenizer_path("word_bpe_49k.json")
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_memo(path).encode
        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in range(5)]
                for key, text in zip(keys[at : at + 256], texts.slice(at, 256), strict=True):
                    ids = encode(text.as_py() or b"") + end
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, limit):
                        for column, value in zip(out, (key, start, length, ids[4 * start : 4 * (start + length)], n), strict=True):
                            column.append(value)
                        start += length
                rows = len(out[0])
                length = np.array(out[2], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(length),
                        pa.array(out[3], pa.binary()), pa.array(out[4], pa.int64()),
                        pa.array(np.arange(serial, serial + rows)), pa.array(np.zeros(rows, np.int64)),
                        pa.array(np.log2(np.maximum(length, 1)).astype(np.int32)),
                    ],
                    ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"],
                )
                serial += rows

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces as one folder of equal lengths each."""
    pieces.write.partitionBy("bucket").parquet(path)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3_pack_power_of_two(spark, sf_dir: str) -> DataFrame:
    return digests(pack_power_of_two(spark.read.parquet(f"{sf_dir}/documents.parquet")))
