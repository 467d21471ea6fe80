"""Text functions: accent folding, tokens, query terms and query clean-up, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def _folding() -> tuple[str, str]:
    """Letters that canonically decompose to an ASCII letter with marks, and those letters."""
    pairs = []
    for code in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and all(unicodedata.combining(c) for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folding()


def fold(text: Column) -> Column:
    """Lower case, without diacritics of Latin letters."""
    return F.translate(F.lower(text), _FROM, _TO)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct tokens of a query, in order of first occurrence; queries are folded as documents are."""
    return F.array_distinct(tokens(text))


def match_expression(text: Column, mode: str = "or") -> Column:
    """Quoted terms joined for a full-text match; null for a query without terms."""
    if mode not in ("or", "and"):
        raise ValueError(f"unknown mode {mode}")
    quoted = F.transform(query_terms(text), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, f" {mode.upper()} "))


def first_words(text: Column, n: int = 50) -> Column:
    """The first n words, joined by blanks."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, n), " ")


# Fixed value: what the encoders' callers put before a query.
PREFIX = r"(?i)^\s*(search(\s+engine)?(\s+query)?|query)\s*[:\-]?\s*"
QUOTES = "\"“”'` "


def clean_query(text: Column) -> Column:
    """First line without "search query:" prefixes and enclosing quotes, both taken off twice."""
    q = F.trim(F.split_part(F.trim(text), F.lit("\n"), F.lit(1)))
    for _ in range(2):
        q = F.trim(F.regexp_replace(q, PREFIX, ""))
        q = F.trim(F.trim(q, F.lit(QUOTES)))
    return q


def contains_word(text: Column, word: Column) -> Column:
    return F.contains(F.lower(text), F.lower(word))


def skip_tokens(ids: Column, skip: list[int]) -> Column:
    """Token ids without those of a skip list."""
    return F.filter(ids, lambda i: ~F.array_contains(F.array(*[F.lit(s) for s in skip]), i))
