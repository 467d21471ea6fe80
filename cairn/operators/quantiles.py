"""Exact quantiles of the numbers in array columns, with neither a sort nor a table of all values.

Numbers are mapped to unsigned integers of the same order, and the order statistics found digit by
digit: each pass counts the next digit of the numbers that share their first digits with one of
them. Once few numbers are left these are fetched. Tasks and driver hold a bounded number of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the digits, from the highest.
DIGITS = (16, 12, 12, 12, 12)
#: Numbers that the driver fetches at the end.
MAX_FETCHED = 1 << 20


def _ordered(x: np.ndarray) -> np.ndarray:
    """float64 as uint64 of the same order; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _number(u: int) -> float:
    bits = u & ~(1 << 63) if u >> 63 else u ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _flat(column: pa.Array) -> np.ndarray:
    return _ordered(column.flatten().drop_null().to_numpy(zero_copy_only=False).astype(np.float64))


def _within(u: np.ndarray, known: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that begin with one of the sorted ``known`` beginnings, and its position for each."""
    if shift == 64:  # nothing is known yet
        return u, np.zeros(len(u), np.int64)
    if not len(known):
        return u[:0], np.zeros(0, np.int64)
    first = u >> np.uint64(shift)
    at = np.minimum(np.searchsorted(known, first), len(known) - 1)
    own = known[at] == first
    return u[own], at[own]


def _counts(df: DataFrame, known: list[np.ndarray], shift: int, bits: int) -> list[dict[int, np.ndarray]]:
    """For each column and position of a beginning, how often each next digit occurs."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(len(own) * size, np.int64) for own in known]
        for batch in batches:
            for k, own in enumerate(known):
                u, at = _within(_flat(batch.column(k)), own, shift)
                digit = (u >> np.uint64(shift - bits)) & np.uint64(size - 1)
                found[k] += np.bincount(at * size + digit.astype(np.int64), minlength=len(found[k]))
        for k, n in enumerate(found):
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), k)), pa.array(full), pa.array(n[full])], ["k", "place", "n"])

    got = df.mapInArrow(run, "k long, place long, n long").groupBy("k", "place").agg(F.sum("n").alias("n")).toArrow()
    k, place, n = (got[c].to_numpy() for c in ("k", "place", "n"))
    out = []
    for j, own in enumerate(known):
        dense = np.zeros(len(own) * size, np.int64)
        dense[place[k == j]] = n[k == j]
        out.append(dict(enumerate(dense.reshape(len(own), size))))
    return out


def _fetched(df: DataFrame, known: list[np.ndarray], shift: int) -> list[dict[int, np.ndarray]]:
    """For each column and position of a beginning, the sorted numbers that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, own in enumerate(known):
                u, at = _within(_flat(batch.column(k)), own, shift)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k)), pa.array(at), pa.array(u.view(np.int64))], ["k", "at", "u"])

    got = df.mapInArrow(run, "k long, at long, u long").toArrow()
    k, at, u = got["k"].to_numpy(), got["at"].to_numpy(), got["u"].to_numpy().view(np.uint64)
    return [{i: np.sort(u[(k == j) & (at == i)]) for i in range(len(own))} for j, own in enumerate(known)]


def quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """For each array column the quantiles of all its elements, between neighbours in proportion; None
    if there are none. Null elements are left out."""
    names = list(wanted)
    source = df.select(*names)
    known, shift = [np.zeros(1, np.uint64) for _ in names], 64
    totals: list[int] = []
    # of each column: rank wanted -> (its beginning so far, rank within that)
    sought: list[dict[int, tuple[int, int]]] = []
    for bits in DIGITS:
        counts = _counts(source, known, shift, bits)
        if shift == 64:
            totals = [int(c[0].sum()) for c in counts]
            for n, name in zip(totals, names, strict=True):
                places = [(n - 1) * q for q in wanted[name]] if n else []
                sought.append({int(r): (0, int(r)) for p in places for r in (np.floor(p), np.ceil(p))})
        shift -= bits
        left = 0
        for k, own in enumerate(sought):
            at = {int(u): i for i, u in enumerate(known[k])}
            sizes = {}
            for rank, (start, rest) in own.items():
                n = counts[k][at[start]]
                before = np.cumsum(n) - n
                digit = int(np.searchsorted(before + n, rest, side="right"))
                own[rank] = (start << bits | digit, rest - int(before[digit]))
                sizes[own[rank][0]] = int(n[digit])
            known[k] = np.array(sorted(sizes), np.uint64)
            left += sum(sizes.values())
        if not shift or left <= MAX_FETCHED:
            break
    values: list[dict[int, float]] = []
    if shift:
        got = _fetched(source, known, shift)
        for k, own in enumerate(sought):
            at = {int(u): i for i, u in enumerate(known[k])}
            values.append({rank: _number(int(got[k][at[start]][rest])) for rank, (start, rest) in own.items()})
    else:
        values = [{rank: _number(start) for rank, (start, _) in own.items()} for own in sought]
    out: dict[str, list[float | None]] = {}
    for n, name, found in zip(totals, names, values, strict=True):
        out[name] = []
        for q in wanted[name]:
            place = (n - 1) * q
            low = int(np.floor(place))
            out[name].append(found[low] + (found[int(np.ceil(place))] - found[low]) * (place - low) if n else None)
    return out
