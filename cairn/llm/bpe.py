"""Byte-level BPE through a minimal acyclic transducer of frequent pieces.

All documents are counted once for their frequent pieces (what the pre-tokenizer's pattern yields):
every task keeps a frequency summary of bounded size that loses no piece above its error bound, and
the summaries are added up. The most frequent pieces are compiled into an automaton that shares
suffixes; its edges carry counts whose sum along a path is the piece's number, under which its ids
are stored. The file is memory-mapped by each worker and walked for all distinct pieces of a batch
at once. Pieces that it does not have are merged exactly, by rank. The lexicon decides the cost of
a piece, never its ids.
"""

from __future__ import annotations

import json
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tokenizer_path

#: Pieces that the automaton holds, and those that a task reports.
LEXICON, REPORTED = 65_536, 8_192
#: Counters that a task keeps.
COUNTERS = 300_000
#: Longest piece in the automaton, in bytes.
LONGEST = 32
#: White space as the pre-tokenizer's pattern has it.
SPACE = "\t-\r \x85\xa0  -     　"
#: Text cut where no piece can cross: a run of other characters with one blank before it, or white space.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: Chunks of one or two pieces: Latin letters, then marks.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%$&*#]*)")


def chunks(text: str) -> list[str]:
    return CHUNK.findall(text)


class Pieces:
    """Pre-tokenizer pattern, exact merges and byte strings of a byte-level vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = [b""] * (1 + max(*ranks.values(), *self.special.values()))
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.merge = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def split(self, chunk: str) -> list[str]:
        m = PLAIN.fullmatch(chunk)
        if m:
            return [m[1], m[2]] if m[2] else [m[1]]
        return self.pattern.findall(chunk)

    def parts(self, text: str) -> list[str]:
        """Text between special tokens, and those."""
        return self.cut.split(text) if self.cut else [text]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """A transducer file from pieces with their ids.

    States that accept the same suffixes are one. An edge's weight is the number of pieces that
    come before those behind it, so the weights of a path add up to the piece's rank in byte order.
    """
    words = sorted(dict(entries).items())
    register: dict[tuple, int] = {}
    kept: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(kept)
            kept.append(key)
        return register[key]

    # the states along the last word: [accepting, settled edges]
    path: list[list] = [[False, []]]
    last = b""
    for word, _ in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for k in range(len(last), common, -1):
            final, edges = path.pop()
            path[-1][1].append((last[k - 1], settle(final, edges)))
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        final, edges = path.pop()
        path[-1][1].append((last[k - 1], settle(final, edges)))
    root = settle(*path[0])
    # children are settled before their parents, so counts need one pass
    behind = np.zeros(len(kept), np.int64)
    keys, targets, weights = [], [], []
    for state, (final, edges) in enumerate(kept):
        n = int(final)
        for byte, target in edges:
            keys.append(state * 256 + byte)
            targets.append(target)
            weights.append(n)
            n += int(behind[target])
        behind[state] = n
    offsets = np.cumsum([0] + [len(ids) for _, ids in words])
    blocks = [
        np.array([len(keys), len(kept), len(words), int(offsets[-1]), root], "<i8"), np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(weights, "<i4"),
        offsets.astype("<i4"), np.array([i for _, ids in words for i in ids], "<u4"), np.array([final for final, _ in kept], "?"),
    ]
    return b"".join(b.tobytes() for b in blocks)


class Lexicon:
    """A transducer file, memory-mapped."""

    def __init__(self, content: bytes):
        self.file = tempfile.TemporaryFile()
        self.file.write(content)
        self.file.flush()
        n_edges, n_states, n_words, n_ids, self.root = np.frombuffer(content, "<i8", 5).tolist()
        at = 40

        def block(kind: str, n: int) -> np.ndarray:
            nonlocal at
            if not n:
                return np.zeros(0, kind)
            out = np.memmap(self.file, kind, "r", at, (n,))
            at += out.nbytes
            return out

        self.keys, self.targets, self.weights = block("<i8", n_edges), block("<i4", n_edges), block("<i4", n_edges)
        self.offsets, self.ids, self.final = block("<i4", n_words + 1), block("<u4", n_ids), block("?", n_states)

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece, -1 for those that are absent."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        state = np.where((lengths > 0) & (lengths <= LONGEST), self.root, -1)
        number = np.zeros(len(pieces), np.int64)
        if not len(self.keys):
            return np.full(len(pieces), -1)
        buffer = np.frombuffer(b"".join(pieces), np.uint8)
        start = np.cumsum(lengths) - lengths
        for k in range(LONGEST):
            on = np.flatnonzero((state >= 0) & (lengths > k))
            if not len(on):
                break
            want = state[on] * 256 + buffer[start[on] + k]
            edge = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            there = self.keys[edge] == want
            state[on] = np.where(there, self.targets[edge], -1)
            number[on] += np.where(there, self.weights[edge], 0)
        return np.where((state >= 0) & self.final[np.maximum(state, 0)], number, -1)

    def ids_of(self, number: int) -> bytes:
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tobytes()


_lexicons: dict[bytes, Lexicon] = {}


def lexicon_of(content: bytes) -> Lexicon:
    key = blake2b(content, digest_size=16).digest()
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(content)
    return _lexicons[key]


def encode_batch(texts: list[str], pieces: Pieces, lexicon: Lexicon) -> list[bytes]:
    """Little-endian 32-bit ids of each text."""
    cut: list[list[str]] = []
    for text in texts:
        own: list[str] = []
        for k, part in enumerate(pieces.parts(text) if any(s in text for s in pieces.special) else (text,)):
            own += [part] if k % 2 else chunks(part)
        cut.append(own)
    table = {s: np.array([i], "<u4").tobytes() for s, i in pieces.special.items()}
    words = [w for w in set().union(*cut) if w not in table]
    split = list(map(pieces.split, words))
    distinct = list({p for s in split for p in s})
    raw = [p.encode() for p in distinct]
    number = lexicon.numbers(raw)
    found: dict[str, bytes] = {}
    starts, ends, ids = lexicon.offsets[number], lexicon.offsets[np.minimum(number + 1, len(lexicon.offsets) - 1)], memoryview(lexicon.ids.view(np.uint8))
    for p, r, n, a, b in zip(distinct, raw, number.tolist(), starts.tolist(), ends.tolist(), strict=True):
        found[p] = bytes(ids[4 * a : 4 * b]) if n >= 0 else np.array(pieces.merge(r), "<u4").tobytes()
    for w, s in zip(words, split, strict=True):
        table[w] = found[s[0]] if len(s) == 1 else b"".join([found[p] for p in s])
    return [b"".join(map(table.__getitem__, own)) for own in cut]


def frequent_pieces(docs: DataFrame, text_col: str, path: str, n: int = LEXICON) -> list[str]:
    """The most frequent pieces over all documents; at most ``n``, which bounds what the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                count.update(chunks(value.as_py() or ""))
                if len(count) > COUNTERS:
                    floor = sorted(count.values())[len(count) // 2]
                    count = Counter({w: c - floor for w, c in count.items() if c > floor})
        pieces, total = pieces_of(path), Counter()
        for w, c in count.items():
            if len(w) <= LONGEST:
                for p in pieces.split(w):
                    total[p] += c
        top = total.most_common(REPORTED)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["piece", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "piece string, n long")
    top = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(n)
    return [r.piece for r in top.collect() if len(r.piece.encode()) <= LONGEST]


def build_lexicon(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> bytes:
    """The transducer file of the frequent pieces of ``docs``."""
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    ship(docs.sparkSession)
    merge = pieces_of(path).merge
    return compile_lexicon((p.encode(), merge(p.encode())) for p in frequent_pieces(docs, text_col, path))


def bpe_round_trip(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str | None = None, lexicon: bytes | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and
    ``decoded``, the text that those ids give.

    Special tokens of the vocabulary are recognised in the text, none is added. Null counts as
    empty and has no ids. Texts are encoded whole; repeated rows get equal rows, null ids are
    carried, other columns are ignored, an empty table stays empty.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(lexicon if lexicon is not None else build_lexicon(docs, text_col, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, own = pieces_of(path), lexicon_of(content.value)
        for batch in batches:
            for part in slices(batch):
                ids = encode_batch([x or "" for x in part.column(1).to_pylist()], pieces, own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(pieces.decode, ids), pa.string())],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)


def slices(batch: pa.RecordBatch, rows: int = 1024, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in order, in parts of at most ``rows`` rows and ``most`` bytes (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = int(np.searchsorted(np.cumsum(sizes[at : at + rows]), most, "right"))
        n = max(1, min(n, batch.num_rows - at))
        yield batch.slice(at, n)
        at += n


def op5_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    done = bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_tokens", F.lower(F.sha2("ids", 256)).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
