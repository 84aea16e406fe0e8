"""The best of many scores, kept where they are made."""

from __future__ import annotations

import numpy as np


def start(n: int, k: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """Scores and keys of the k best of n queries, none yet."""
    return np.full((n, k), -np.inf), np.zeros((n, k), kind)


def merge(best: np.ndarray, names: np.ndarray, of: np.ndarray, value: np.ndarray, key: np.ndarray) -> None:
    """Scores ``value`` of ``key`` for queries ``of`` (ascending) go into the k best, in place: by rounded score, ties by key."""
    if not len(of):
        return
    k = best.shape[1]
    met = of[np.flatnonzero(np.append(True, np.diff(of) > 0))]  # queries with candidates
    value, key, of = np.concatenate([best[met].ravel(), value]), np.concatenate([names[met].ravel(), key]), np.concatenate([np.repeat(met, k), of])
    held = value > -np.inf
    value, key, of = value[held], key[held], of[held]
    order = np.lexsort((key, -value.round(9), of))
    value, key, of = value[order], key[order], of[order]
    first = np.flatnonzero(np.append(True, np.diff(of) > 0))
    place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    kept = place < k
    best[of[kept], place[kept]], names[of[kept], place[kept]] = value[kept], key[kept]
