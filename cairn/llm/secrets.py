"""Secret scans: fixed patterns, and strings that a tiktoken vocabulary can't shorten.

Natural words compress to few tokens, random strings don't: a run of key characters with mixed
classes whose characters-per-token ratio is low is taken for a secret, unless it is a digest of a
known length or an identifier. Runs join keys to paths, URLs and names, whose words raise the
ratio, so the parts between separators and the low-ratio spans of a run are tested too. Work is
per row; no exchange.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tokenizer_path

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs with a digit or a capital after a small letter, of 8 characters or more, that may be or hold random
#: strings; they start where no run goes on.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_=-]{8,}")
#: Letters of one case, which words are made of too, from this length on.
WORD = re.compile(r"(?<!\w)(?=[A-Za-z]{20})(?:[A-Z]?[a-z]+|[A-Z]+)(?!\w)")
#: Runs with marks between letters and digits, as passwords have them; not addresses.
MARKED = re.compile(r"(?<![^\s\"'`<>()\[\]{},;:])(?=\S*[0-9])(?=\S*[A-Za-z])[A-Za-z0-9!@#$%^&*+/_=?~-]{12,}")
MARKS = re.compile(r"[A-Za-z0-9][!@#$%^&*?~]+(?=[A-Za-z0-9])")
#: Strings of several parts, as signed tokens are.
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])(?=[A-Za-z_.-]*[0-9])[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,})+(?![A-Za-z0-9_.-])")
ADDRESS = re.compile(r"[A-Za-z0-9+/_=-]+@[A-Za-z0-9-]+")
PART = re.compile(r"[A-Za-z0-9]{8,}")
#: Strings with separators count as one from this length on; those of letters of both cases from CASED on.
LONG, CASED = 20, 12
SEPARATORS = "+/_=-"
DIGIT, LETTER, MIXED = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]"), re.compile(r"[a-z][+/_=-]*[A-Z]")
#: Lengths of hexadecimal digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
UUID_PART = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])")
#: Short parts that are a word and a number, or a time.
SERIAL = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+)[0-9]+|[0-9]+(?:[A-Za-z]?[a-z]+|[A-Z]+)|[0-9]{2,8}T[0-9]{2,6}Z?")
#: Words joined by separators, each all letters or all digits: names, paths, dates, serials.
NAME = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/=+](?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+))*")
#: Characters per token: below this a run counts as random. Base64 of random bytes lies near 1.5, prose above 2.5.
RATIO = 2.0
#: The same for runs with marks or dots, which are tokens of their own.
MARKED_RATIO = 1.7

_encodings: dict[str, object] = {}


def encoding(path: str):
    if path not in _encodings:
        import tiktoken

        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("runs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def is_identifier(s: str) -> bool:
    """Digests of a known length, UUIDs, and names made of plain words or numbers."""
    return bool((HEX_ONLY.fullmatch(s) and len(s) in DIGEST_LENGTHS) or UUID.fullmatch(s) or NAME.fullmatch(s))


def _suspect(s: str) -> bool:
    """Letters with digits, or letters of both cases; no identifier."""
    mixed = LETTER.search(s) if DIGIT.search(s) else len(s) >= CASED and MIXED.search(s)
    return bool(mixed) and not is_identifier(s)


def _low_spans(s: str, enc, ratio: float) -> list[tuple[int, int]]:
    """The maximal spans of tokens with fewer than ``ratio`` characters a token (Ruzzo and Tompa)."""
    # start, end, total before and total after of each candidate; below: the nearest earlier one that started lower
    spans: list[tuple[int, int, float, float, int]] = []
    at, total = 0, 0.0
    for token in enc.encode_ordinary(s):
        size = len(enc.decode_single_token_bytes(token))
        start, end, before, after = at, at + size, total, total + ratio - size
        at, total = end, after
        if after <= before:
            continue
        while True:
            k = len(spans) - 1
            while k >= 0 and spans[k][2] >= before:
                k = spans[k][4]
            if k < 0 or spans[k][3] >= after:
                spans.append((start, end, before, after, k))
                break
            start, before = spans[k][0], spans[k][2]
            del spans[k:]
    return [x[:2] for x in spans]


def _inner_runs(s: str, enc, ratio: float) -> list[tuple[int, int]]:
    """Random strings in a run that is none as a whole; overlapping ones as one."""
    known = [m.span() for m in UUID_PART.finditer(s)]
    found, cuts = [], list(known)
    for m in PART.finditer(s):
        part = m.group()
        if any(a <= m.start() and m.end() <= b for a, b in known):
            continue
        if is_identifier(part):
            cuts += [m.span()] * (HEX_ONLY.fullmatch(part) is not None and len(part) in DIGEST_LENGTHS)
        elif _suspect(part) and (len(part) >= LONG or not SERIAL.fullmatch(part)) and len(part) < ratio * len(enc.encode_ordinary(part)):
            found.append(m.span())
    at = 0
    for cut, after in [*sorted(cuts), (len(s), len(s))]:
        piece, base, at = s[at:cut], at, after
        if len(piece) < LONG:
            continue
        for a, b in _low_spans(piece, enc, ratio):
            if b - a < LONG // 2:
                continue
            # a key's first and last tokens may be long: whole parts
            while a > 0 and piece[a - 1] not in SEPARATORS:
                a -= 1
            while b < len(piece) and piece[b] not in SEPARATORS:
                b += 1
            inner = piece[a:b].rstrip("/_-")
            b = a + len(inner)
            a = b - len(inner.lstrip(SEPARATORS))
            plain = all(NAME.fullmatch(x) or SERIAL.fullmatch(x) for x in re.split("[+/_=-]+", piece[a:b]) if x)
            if b - a >= LONG and _suspect(piece[a:b]) and not plain:
                found.append((base + a, base + b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def random_runs(text: str, enc, ratio: float = RATIO) -> list[tuple[int, int]]:
    """Spans of random strings; those that a dot or nothing parts are one.

    Not told from other text by their tokens, and so not found: letters of one case below ``LONG``,
    letters of both cases below ``CASED``, digits alone, and strings below 8 characters.
    """
    out = []
    for m in RUN.finditer(text):
        s = m.group()
        if not _suspect(s):
            continue
        if len(s) >= LONG and len(s) < ratio * len(enc.encode_ordinary(s)):
            out.append(m.span())
        else:
            out += [(m.start() + a, m.start() + b) for a, b in _inner_runs(s, enc, ratio)]
    for m in WORD.finditer(text):
        if len(m.group()) < ratio * len(enc.encode_ordinary(m.group())):
            out.append(m.span())
    for m in MARKED.finditer(text):
        s = m.group().rstrip("!@#$%^&*?~")
        if len(s) >= CASED and len(MARKS.findall(s)) > 0 and not ADDRESS.fullmatch(s) and len(s) < MARKED_RATIO * len(enc.encode_ordinary(s)):
            out.append((m.start(), m.start() + len(s)))
    for m in DOTTED.finditer(text):
        if LETTER.search(m.group()) and len(m.group()) < MARKED_RATIO * len(enc.encode_ordinary(m.group())):
            out.append(m.span())
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and (a <= merged[-1][1] or text[merged[-1][1] : a] == "."):
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def find_secrets(text: str, enc, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order of start and kind; code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(a, 3, b) for a, b in random_runs(text, enc, ratio)]
    return sorted(found)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[REDACTED]") -> str:
    """Replace the spans, overlapping ones as one."""
    merged: list[list[int]] = []
    for start, _, end in spans:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    out, at = [], 0
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ratio: float = RATIO, vocabulary: str | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_assign``, ``n_access``, ``n_hex``, ``n_random``,
    ``base_spans`` and ``spans`` (``kind:start:end``, comma-joined) and, with ``with_text``,
    ``redacted``: the text with every span replaced, null where the text is null.

    Null counts as empty and has no span. Whole texts of any length are read; repeated rows get
    equal rows, null ids are carried, other columns are ignored, an empty table stays empty.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.tiktoken")
    ship(docs.sparkSession)
    names = ["id", "n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans"] + ["redacted"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts: list[list[int]] = [[], [], [], []]
                base, spans, clean = [], [], []
                for value in part.column(1):
                    text = value.as_py()
                    found = find_secrets(text or "", enc, ratio)
                    for k, column in enumerate(counts):
                        column.append(sum(x[1] == k for x in found))
                    shown = [(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in found]
                    base.append(",".join(s for k, s in shown if k < 3))
                    spans.append(",".join(s for _, s in shown))
                    if with_text:
                        clean.append(redact(text, found) if found else text)
                arrays = [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(clean, pa.string())] * with_text, names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string" + ", redacted string" * with_text
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redactor(spark, ratio: float = RATIO, vocabulary: str | None = None):
    """A column function from texts to texts with their secrets replaced; null stays null."""
    path = vocabulary or tokenizer_path("byte_bpe_50k.tiktoken")
    ship(spark)

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for part in texts:
            yield pd.Series([redact(x, find_secrets(x, enc, ratio)) if x else x for x in part], dtype=object)

    return clean


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
