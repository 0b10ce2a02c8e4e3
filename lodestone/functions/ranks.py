"""Scores and the best of them, in NumPy."""

from __future__ import annotations

import numpy as np


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to 6 places as SQL rounds: halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6


def best_of(row: np.ndarray, score: np.ndarray, place: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each row by score, ties by id; ``place`` points into ids."""
    order = np.lexsort((ids[place], -score, row))
    row, score, place = row[order], score[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    keep = nth < k
    return row[keep], score[keep], place[keep]
