"""The best few of many scores for each row, kept while scores come block by block."""

from __future__ import annotations

import numpy as np

#: Rows and others whose scores a task holds at once: 8 MB, and some times that while the best are chosen.
SIDE = 1_024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; zero rows stay."""
    x = x.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All products of rows; both sides are filled up to SIDE rows, so that equal rows get equal products wherever they stand."""
    full = [np.concatenate([a, np.zeros((-len(a) % SIDE, a.shape[1]))]) for a in (x, y)]
    return (full[0] @ full[1].T)[: len(x), : len(y)]


class Best:
    """For each of ``n`` rows the ``k`` others of greatest score, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.other = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def meet(self, low: int, score: np.ndarray, others: np.ndarray) -> None:
        """``score`` of the rows from ``low`` on with ``others``; only rows with one that may be among their best are ranked anew."""
        some = np.flatnonzero((score >= self.score[low : low + len(score), -1:]).any(axis=1))
        if not len(some):
            return
        at, s, k = low + some, score[some], self.k
        bar = self.score[at, -1]
        if s.shape[1] > k:  # what is under a row's k-th new score can't be among its best either
            bar = np.maximum(bar, np.partition(s, -k, axis=1)[:, -k])
        row, column = np.nonzero(s >= bar[:, None])
        rows = np.concatenate([np.repeat(np.arange(len(at)), k), row])
        every = np.concatenate([self.score[at].ravel(), s[row, column]])
        other = np.concatenate([self.other[at].ravel(), others[column]])
        order = np.lexsort((other, -every, rows))
        # each row has k at least, of which the first k stay
        first = np.searchsorted(rows[order], np.arange(len(at)))
        order = order[first[:, None] + np.arange(k)]
        self.score[at], self.other[at] = every[order], other[order]

    def over(self, ids: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, other, score) of what is over ``least``."""
        row, at = np.nonzero(self.score > least)
        return ids[row], self.other[row, at], self.score[row, at]
