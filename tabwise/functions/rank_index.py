"""Order statistics of many windows at once: a wavelet matrix over time, and value indexes of time cells.

Values are handled as integers in the same order (``ordered``), NaN being the largest. A wavelet matrix holds, for each
binary digit of the values' ranks, how much weight lies on the zero side before each place; the value of a given rank in a
window is found by counting down one digit at a time, for all windows together.

A window that spans many cells does not need their rows. Of each cell an index of every s-th order statistic is enough to
bracket where a window's median can lie (``bracket``); only the values inside it are then looked at.
"""

from __future__ import annotations

import numpy as np

SAMPLES = 1024
TOP, BOTTOM = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order; all NaN are one value, and so are both zeros."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = values.view(np.int64)
    return np.where(bits < 0, bits ^ TOP, bits)


def doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, keys ^ TOP, keys).view(np.float64)


def select(codes: np.ndarray, weights: np.ndarray, ranges: list[tuple[np.ndarray, np.ndarray]],
           rank: np.ndarray) -> np.ndarray:
    """Code at 0-based ``rank`` (by weight) of each window, which consists of several ranges of entries, (start, end)."""
    digits = max(1, int(codes.max(initial=0)).bit_length())
    found, rank = np.zeros(len(rank), np.int64), rank.copy()
    for digit in reversed(range(digits)):
        zero = (codes >> digit) & 1 == 0
        zeros = np.concatenate(([0], np.cumsum(zero)))
        weight = np.concatenate(([0], np.cumsum(np.where(zero, weights, 0))))
        below = sum(weight[end] - weight[start] for start, end in ranges)
        right = rank >= below
        rank -= np.where(right, below, 0)
        found += np.where(right, 1 << digit, 0)
        ones = lambda at: np.where(right, zeros[-1] + at - zeros[at], zeros[at])  # noqa: B023 - called at once
        ranges = [(ones(start), ones(end)) for start, end in ranges]
        codes = np.concatenate((codes[zero], codes[~zero]))
        weights = np.concatenate((weights[zero], weights[~zero]))
    return found


def index(keys: np.ndarray, counts: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, rows below, rows up to and including) at every s-th order statistic of sorted distinct keys."""
    upto = np.cumsum(counts)
    if not len(upto):
        return keys, upto, upto
    step = max(1, -(-int(upto[-1]) // samples))
    kept = np.flatnonzero(np.diff(np.concatenate(([-1], upto // step))) > 0)
    kept = np.unique(np.concatenate(([0], kept, [len(keys) - 1])))
    return keys[kept], upto[kept] - counts[kept], upto[kept]


def bracket(cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]], others: int) -> tuple[int, int]:
    """(low, high): every median of the rows of ``cells`` and up to ``others`` more is above low and at most high,
    or is one of the others.
    """
    values = np.unique(np.concatenate([c[0] for c in cells]))
    surely, maybe, total = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64), 0
    for held, below, upto in cells:
        if not len(held):
            continue
        total += int(upto[-1])
        at = np.searchsorted(held, values, "right")
        surely += np.where(at > 0, upto[at - 1], 0)
        exact = (at > 0) & (held[at - 1] == values)
        following = np.append(below, upto[-1])[at]
        maybe += np.where(exact, upto[at - 1], following)
    lows = values[maybe + others <= (total - 1) // 2]
    highs = values[surely >= (total + others) // 2 + 1]
    return int(lows[-1]) if len(lows) else BOTTOM, int(highs[0]) if len(highs) else TOP
