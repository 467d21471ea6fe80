"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams of code points, in lower case. Each feature is scaled by
the log of how much more of the toxic texts' features it makes up than of the others', and a
ridge-penalised logistic regression is fitted on the scaled features. It is fitted on a bounded
sample of labelled rows; scoring is one pass over all rows, without an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: n-gram lengths and the number of hashed features.
LENGTHS, BUCKETS = (5, 6), 1 << 20
#: Labelled rows that the classifier is fitted on, at most: half of them of either label.
MAX_TRAINING_ROWS = 3_000
#: Features are used when this many rows have them and their log-count ratio is this far from 0.
MIN_ROWS, MIN_RATIO = 4, 1.5
_TIMES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xB5297A4D, 0x68E31DA5, 0x1B56C4E9], np.uint32)


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Sorted distinct feature numbers of a text; a blank is put at either end."""
    code = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), np.uint32)
    found = []
    for n in LENGTHS:
        m = len(code) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ code[k : k + m]) * _TIMES[k]
            h ^= h >> np.uint32(15)
        found.append(h & np.uint32(buckets - 1))
    if len(code) < 8192:
        return np.unique(np.concatenate(found or [code[:0]])).astype(np.int32)
    seen = np.zeros(buckets, np.bool_)
    for h in found:
        seen[h] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # float32, scaling included
    bias: float

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[features(text, len(self.weights))].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, smoothing: float = 1.0, penalty: float = 30.0, steps: int = 50) -> Model:
    """Fit on feature sets and 0/1 labels; without both labels the score is their share everywhere."""
    n = len(rows)
    positive = int(labels.sum()) if n else 0
    if not 0 < positive < n:
        share = (positive + 0.5) / (n + 1)
        return Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))))
    p, total = np.zeros(buckets), np.zeros(buckets)
    for r, label in zip(rows, labels, strict=True):
        total[r] += 1
        if label:
            p[r] += 1
    q = total - p + smoothing
    p += smoothing
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    # rare features tell rows apart, not labels, and a ratio near 0 adds nothing
    ratio[(total < MIN_ROWS) | (abs(ratio) < MIN_RATIO)] = 0
    used = np.flatnonzero(ratio)
    place = np.full(buckets, -1, np.int32)
    place[used] = np.arange(len(used))
    placed = [c[c >= 0] for c in (place[r] for r in rows)]
    column = np.concatenate(placed)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in placed])
    value = ratio[used][column]
    # rows of either label weigh the same in total
    weight = np.where(labels == 1, n / (2 * positive), n / (2 * (n - positive)))
    norm = np.zeros(n)
    np.add.at(norm, row, value**2)
    rate = 1.0 / (0.25 * weight.max() * max(norm.max(), 1.0) + penalty)
    return _descend(column, row, value, labels, weight, used, ratio, buckets, n, penalty, steps, rate)


def _descend(column, row, value, labels, weight, used, ratio, buckets, n, penalty, steps, rate) -> Model:
    """L-BFGS on the weighted logistic loss."""

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:-1], x[-1]
        z = b + np.bincount(row, weights=w[column] * value, minlength=n)
        s = np.where(labels == 1, 1.0, -1.0)
        m = s * z
        f = float((weight * np.logaddexp(0, -m)).sum() + 0.5 * penalty * (w @ w))
        e = -weight * s / (1 + np.exp(np.clip(m, -500, 500)))
        g = np.bincount(column, weights=e[row] * value, minlength=len(w)) + penalty * w
        return f, np.append(g, e.sum())

    x = np.zeros(len(used) + 1)
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, kept = -g, []
        for s, y, r in reversed(past):
            a = r * (s @ d)
            kept.append(a)
            d = d - a * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else rate)
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            d = d + (a - r * (y @ d)) * s
        step, slope = 1.0, g @ d
        for _ in range(30):
            f2, g2 = loss(x + step * d)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, g2 - g
        x, done = x + s, f - f2 < 1e-6 * max(1.0, f)
        f, g = f2, g2
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y, 1 / (s @ y))]
        if done:
            break
    weights = np.zeros(buckets, np.float32)
    weights[used] = x[:-1] * ratio[used]
    return Model(weights, float(x[-1]))


def held_out(id_col: str):
    """True for the fifth of the rows that never train."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fit on the labelled rows of ``docs`` that are not held out.

    Of either label the ``max_rows`` / 2 rows whose ids hash lowest are taken, which bounds what the
    driver gets. Labels without id or value don't count; of several for one id the largest does.
    Texts are read whole; null counts as empty.
    """
    ship(docs.sparkSession)
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).cast("long").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("_toxic"))
    )
    order = (F.xxhash64("_id"), F.col("_id"))
    sample = known.where("_toxic = 1").orderBy(*order).limit(max_rows // 2).unionByName(known.where("_toxic = 0").orderBy(*order).limit(max_rows // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [features(x.as_py() or "").tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["id", "toxic", "features"])

    # at most max_rows ids are broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), "_id")
    got = rows.select("_id", "_toxic", "_text").mapInArrow(run, "id long, toxic int, features binary").collect()
    got.sort(key=lambda r: (r.id, r.features))
    return fit([np.frombuffer(r.features, np.int32) for r in got], np.array([r.toxic for r in got], np.float64))


def scorer(spark, model: Model):
    """A column function from texts to scores from 0 to 1."""
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for part in texts:
            yield pd.Series([own.score(x or "") for x in part], dtype="float64")

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` and ``predicted`` (score >= 0.5).

    The text alone decides a score; a null or empty text has that of a text without features.
    Repeated rows get equal rows; a null id is carried and not held out. Without labels, or with
    one label only, every score is the smoothed share of toxic rows. Other columns are ignored.
    """
    score = scorer(docs.sparkSession, train(docs, labels, text_col, id_col, max_rows))
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(F.col(text_col).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
