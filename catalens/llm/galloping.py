"""Search of sorted lists in longer ones by doubling steps, then by halves; all searches of a list at once."""

from __future__ import annotations

import numpy as np

#: Of so many neighbouring values one is sought first, and the others start where it ends.
STRIDE = 8


def gallop(wanted: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each wanted value the first place in [low, high) of ``longer`` that is not smaller, or ``high``."""
    low, high = low.copy(), high.copy()
    open_, step = np.flatnonzero(low < high), 1
    while len(open_):  # doubling: the answer lies between the last two probes
        probe = low[open_] + (step - 1)
        inside = probe < high[open_]
        open_, probe = open_[inside], probe[inside]
        less = longer[probe] < wanted[open_]
        high[open_[~less]] = probe[~less]
        open_ = open_[less]
        low[open_] = probe[less] + 1
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):  # halving
        middle = (low[open_] + high[open_]) // 2
        less = longer[middle] < wanted[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each value of ``a`` the first place in ``b`` that is not smaller; both are sorted."""
    if len(a) <= STRIDE:
        return gallop(a, b, np.zeros(len(a), np.int64), np.full(len(a), len(b)))
    at = places(a[::STRIDE], b)
    # A value beyond one sought before lies between that one's place and the next one's.
    low = np.repeat(at, STRIDE)[: len(a)]
    high = np.repeat(np.append(at[1:], len(b)), STRIDE)[: len(a)]
    return gallop(a, b, low, high)


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the values both hold; both are sorted without repeats, the shorter one drives."""
    if len(a) > len(b):
        return common(b, a)[::-1]
    place = places(a, b)
    mine = np.flatnonzero(place < len(b))
    mine = mine[b[place[mine]] == a[mine]]
    return mine, place[mine]
