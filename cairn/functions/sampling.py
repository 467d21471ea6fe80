"""Sampling from token scores: repetition penalty, temperature and a floor relative to the best."""

from __future__ import annotations

import numpy as np


def min_p_sample(logits: np.ndarray, seen: list[int], rng: np.random.Generator, temperature: float = 1.0, min_p: float = 0.1, penalty: float = 1.0) -> int:
    """A token number. Scores of seen tokens shrink by the penalty; tokens less likely than ``min_p``
    times the best are left out; temperature 0 takes the best."""
    scores = np.asarray(logits, np.float64).copy()
    own = np.unique(np.asarray(seen, np.int64))
    if penalty != 1.0 and len(own):
        scores[own] = np.where(scores[own] > 0, scores[own] / penalty, scores[own] * penalty)
    if temperature <= 0:
        return int(scores.argmax())
    p = np.exp((scores - scores.max()) / temperature)
    p[p < min_p * p.max()] = 0
    return int(rng.choice(len(p), p=p / p.sum()))
