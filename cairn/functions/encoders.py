"""Inputs of text encoders: ids with a prefix, cut so that the closing token stays.

Weights are not part of this engine; ids need a tokenizer file only, whose path is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's strip() takes for white space, as a character class.
BLANK = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def lower_each(text: Column) -> Column:
    """For tokenizers that lower-case letter by letter: a final capital sigma becomes a plain small one."""
    return F.replace(text, F.lit("\u03a3"), F.lit("\u03c3"))


def truncate(ids: Column, most: int) -> Column:
    """The first ids, ``most`` with the last one, which stays."""
    return F.when(F.size(ids) <= most, ids).otherwise(F.concat(F.slice(ids, 1, most - 1), F.slice(ids, -1, 1)))


def with_prefix(ids: Column, prefix: int) -> Column:
    """The ids with a prefix after the first of them."""
    return F.concat(F.slice(ids, 1, 1), F.array(F.lit(prefix)), F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))))


def token_ids(text: Column, tokenizer: str, add_special_tokens: bool = True) -> Column:
    """Ids by the tokenizer file at a path that workers can open; null counts as empty."""

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer)
        own.no_truncation()
        own.no_padding()
        for part in parts:
            yield pd.Series([e.ids for e in own.encode_batch([x or "" for x in part], add_special_tokens=add_special_tokens)], dtype=object)

    return encode(strip(text.cast("string")))


def encoder_input(text: Column, tokenizer: str, most: int = 256, prefix: int | None = None) -> Column:
    """What an encoder reads: ids of the stripped text, at most ``most`` of them with the prefix."""
    ids = token_ids(lower_each(text), tokenizer)
    return truncate(ids, most) if prefix is None else with_prefix(truncate(ids, most - 1), prefix)
