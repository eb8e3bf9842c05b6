"""Plain-Python versions that tests hold operators against."""

from __future__ import annotations

import numpy as np


def least_assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least total cost; rows must not outnumber columns."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while row_of[at]:
            done[at] = True
            reduced = cost[row_of[at] - 1] - u[row_of[at]] - v[1:]
            free = ~done[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            back[1:][better] = at
            at_next = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            step = least[at_next]
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
            at = at_next
        while at:
            row_of[at] = row_of[back[at]]
            at = back[at]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out
