"""Suffix arrays by linear grouping, without recursive renaming.

A suffix starts with its Lyndon prefix, the part up to the next smaller suffix. Suffixes with equal Lyndon prefixes form a
group. The first phase makes the groups: it starts from single symbols and goes through the groups in descending order.
For every member it finds the nearest earlier suffix of a smaller group (the previous-smaller pointer); that suffix's
prefix continues with the member's, so it moves up to a new group behind its old one, the further up the more members
point to it. The second phase goes through the sorted suffixes in ascending order and puts every suffix whose next
smaller suffix has just been met at the next free place of its group.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order; symbols are numbers, the end counts as smallest."""
    n = len(symbols) + 1
    ranks = np.concatenate((np.unique(symbols, return_inverse=True)[1] + 1, [0])).astype(np.int64)
    group, previous = _groups(ranks)
    return np.array(_emit(group, previous, n)[1:], np.int64)


def _groups(ranks: np.ndarray) -> tuple[list[int], list[int]]:
    """(first place of each suffix's group, previous-smaller pointers; -1 where there is none)."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    first = np.concatenate(([0], np.cumsum(np.bincount(ranks))[:-1]))
    group = first[ranks].tolist()
    at, place = order.tolist(), place.tolist()
    previous = [-1] * n
    end = n
    while end > 0:
        start = group[at[end - 1]]
        members = at[start:end] if end - start == 1 else sorted(at[start:end])
        pointed: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            _move_up(pointed, group, at, place)
        end = start
    return group, previous


def _move_up(pointed: dict[int, int], group: list[int], at: list[int], place: list[int]) -> None:
    """Split the groups of the suffixes pointed to, by how often each is."""
    split: dict[int, dict[int, list[int]]] = {}
    for p, times in pointed.items():
        split.setdefault(group[p], {}).setdefault(times, []).append(p)
    for start, by_times in split.items():
        end = start
        if len(by_times) == 1:  # the whole group stays together
            (only,) = by_times.values()
            end = _group_end(start, group, at)
            if len(only) == end - start:
                continue
        else:
            end = _group_end(start, group, at)
        for times in sorted(by_times, reverse=True):
            moved = by_times[times]
            new = end - len(moved)
            taken = end
            for p in moved:
                taken -= 1
                here, other = place[p], at[taken]
                at[here], at[taken] = other, p
                place[other], place[p] = here, taken
            for p in moved:
                group[p] = new
            end = new


def _group_end(start: int, group: list[int], at: list[int]) -> int:
    """Place behind the last member; doubling steps, then halving, as groups are contiguous."""
    n, step = len(at), 1
    while start + step < n and group[at[start + step]] == start:
        step *= 2
    low, high = start + step // 2, min(start + step, n)
    while high - low > 1:
        middle = (low + high) // 2
        if group[at[middle]] == start:
            low = middle
        else:
            high = middle
    return high


def _emit(group: list[int], previous: list[int], n: int) -> list[int]:
    free = list(range(n))
    placed = [False] * n
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = previous[s]
    return out
