"""Moments of a sliding time window, kept as two stacks.

The back stack takes new points and keeps one running state of all of them; the front stack holds, for each of its points,
the state of that point and all later ones of the front. The state of a window is one front entry merged with the running
state, whatever the window holds. Once the front has slid out, the back is turned into a new front by one pass. Every point
is written, turned and dropped once, so the work per arrival does not depend on the window.

At most ``BLOCK`` front entries (the oldest) and ``BLOCK`` back points (the newest) lie in the memory of a key; further ones
lie in blocks of that size, of which only those at the edges of the window are read.
"""

from __future__ import annotations

import numpy as np

from tabwise.functions import moments
from tabwise.streaming.state import BLOCK, Blocks

NO_TIMES = np.zeros(0, np.int64)


class Window:
    """Two stacks for one window over several columns; plain data, kept pickled between batches."""

    def __init__(self, span: int, columns: int, number: int, block: int = BLOCK):
        self.span, self.columns, self.next, self.stride, self.block = span, columns, number, 1 << 20, block
        self.front: list[int] = []  # block numbers, oldest first
        self.back: list[int] = []
        self.front_times, self.front_states = NO_TIMES, None
        self.back_times, self.back_states, self.total = NO_TIMES, None, None
        self.oldest_back: int | None = None

    def _number(self) -> int:
        self.next += self.stride  # windows of a key use numbers of their own
        return self.next

    def _drop(self, bound: int, blocks: Blocks) -> None:
        """Forget front entries at or before ``bound``."""
        while True:
            keep = np.searchsorted(self.front_times, bound, "right")
            if keep < len(self.front_times):
                self.front_times = self.front_times[keep:]
                self.front_states = [moments.take(s, slice(keep, None)) for s in self.front_states]
                return
            self.front_times, self.front_states = NO_TIMES, None
            if not self.front:
                return
            self.front_times, self.front_states = blocks.take(self.front.pop(0))

    def _turn(self, bound: int, blocks: Blocks) -> None:
        """Make the back the front, leaving out points at or before ``bound``."""
        held = [blocks.take(n) for n in self.back] + [(self.back_times, self.back_states)]
        times = np.concatenate([t for t, _ in held])
        states = [moments.joined([s[i] for _, s in held]) for i in range(self.columns)]
        keep = np.searchsorted(times, bound, "right")
        times, states = times[keep:], [moments.take(s, slice(keep, None)) for s in states]
        self.back, self.back_times, self.back_states, self.total, self.oldest_back = [], NO_TIMES, None, None, None
        if not len(times):
            return
        states = [moments.suffixes(s, np.full(len(times), len(times) - 1)) for s in states]
        for start in range(self.block, len(times), self.block):
            part = slice(start, start + self.block)
            self.front.append(self._number())
            blocks.write(self.front[-1], (times[part], [moments.take(s, part) for s in states]))
        first = slice(0, self.block)
        self.front_times, self.front_states = times[first], [moments.take(s, first) for s in states]

    def _push(self, times: np.ndarray, states: list[moments.State], last: list[moments.State], blocks: Blocks) -> None:
        self.oldest_back = int(times[0]) if self.oldest_back is None else self.oldest_back
        if self.back_states is not None:
            times = np.concatenate((self.back_times, times))
            states = [moments.joined([a, b]) for a, b in zip(self.back_states, states)]
        full = len(times) // self.block * self.block
        for start in range(0, full, self.block):
            part = slice(start, start + self.block)
            self.back.append(self._number())
            blocks.write(self.back[-1], (times[part], [moments.take(s, part) for s in states]))
        self.back_times, self.back_states, self.total = times[full:], [moments.take(s, slice(full, None)) for s in states], last

    def advance(self, times: np.ndarray, states: list[moments.State], blocks: Blocks) -> list[moments.State]:
        """State of the window ending at each of the new points, which follow all earlier ones."""
        found, at = [[] for _ in range(self.columns)], 0
        while at < len(times):
            bound = int(times[at]) - self.span
            self._drop(bound, blocks)
            if not len(self.front_times) and self.oldest_back is not None and self.oldest_back <= bound:
                self._turn(bound, blocks)
            # Points are taken together until the front entries in memory have slid out, or the back would have to.
            if len(self.front_times):
                stop = int(np.searchsorted(times, self.front_times[-1] + self.span, "left"))
            else:
                stop = int(np.searchsorted(times, (int(times[at]) if self.oldest_back is None else self.oldest_back) + self.span, "left"))
            part = slice(at, max(stop, at + 1))
            place = np.searchsorted(self.front_times, times[part] - self.span, "right")
            ends = []
            for i in range(self.columns):
                mine = moments.take(states[i], part)
                if self.total is not None:
                    mine = moments.joined([self.total[i], mine])
                run = moments.prefixes(mine, np.zeros(len(mine["n"]), np.int64))
                run = moments.take(run, slice(-(part.stop - at), None))
                ends.append(moments.take(run, slice(-1, None)))
                if len(self.front_times):
                    run = moments.merge(moments.take(self.front_states[i], place), run)
                found[i].append(run)
            self._push(times[part], [moments.take(s, part) for s in states], ends, blocks)
            at = part.stop
        return [moments.joined(f) for f in found]

    def clear(self, blocks: Blocks) -> None:
        for number in [*self.front, *self.back]:
            blocks.take(number)
