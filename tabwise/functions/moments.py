"""Mergeable moments as arrays: one entry per point or cell, merged pairwise in log-many rounds.

A state is a dict of arrays of equal length. ``n``, ``ym``, ``y2`` are count, mean and summed squares of the values; ``rows``,
``tm``, ``t2`` those of the times of all rows; ``pm``, ``c`` mean time and co-moment over the valued rows; ``low`` and
``high`` are ranks of values with ``NONE`` for a state without one, or doubles with NaN for that. Which fields exist
depends on the needs.
"""

from __future__ import annotations

import numpy as np

State = dict[str, np.ndarray]
NONE = -1


def empty_like(s: State, size: int) -> State:
    missing = lambda v: np.nan if v.dtype.kind == "f" else NONE
    return {k: np.full(size, missing(v) if k in ("low", "high") else 0, v.dtype) for k, v in s.items()}


def take(s: State, at) -> State:
    return {k: v[at] for k, v in s.items()}


def put(s: State, at, values: State) -> None:
    for k, v in values.items():
        s[k][at] = v


def joined(states: list[State]) -> State:
    return {k: np.concatenate([s[k] for s in states]) for k in states[0]}


def of_points(values: np.ndarray, seconds: np.ndarray, group: np.ndarray) -> State:
    """All fields, per point, from rows (NaN for no value) that lie together by point; ``group`` numbers the points."""
    size = int(group[-1]) + 1 if len(group) else 0
    valued = ~np.isnan(values)
    total = lambda x, at=slice(None): np.bincount(group[at], x[at], size)
    n, rows = np.bincount(group[valued], minlength=size).astype(float), np.bincount(group, minlength=size).astype(float)
    mean = np.divide(total(values, valued), n, out=np.zeros(size), where=n > 0)
    first = np.searchsorted(group, np.arange(size))
    low, high = (np.full(size, np.nan) for _ in range(2))
    if size:
        with np.errstate(invalid="ignore"):
            low, high = np.fmin.reduceat(values, first), np.fmax.reduceat(values, first)
    at = seconds[first] if size else np.zeros(0)  # rows of a point share their time
    return {"n": n, "ym": mean, "y2": total((np.where(valued, values, 0) - mean[group]) ** 2, valued), "rows": rows, "tm": at,
            "t2": np.zeros(size), "pm": np.where(n > 0, at, 0.0), "c": np.zeros(size), "low": low, "high": high}


def value(s: State, op: str) -> np.ndarray:
    """Result of an operation; NaN where it has none. ``delta`` still lacks the current value."""
    with np.errstate(invalid="ignore", divide="ignore"):
        match op:
            case "mean":
                return np.where(s["n"] > 0, s["ym"], np.nan)
            case "min" | "delta":
                return s["low"]
            case "max":
                return s["high"]
            case "std":
                return np.where(s["n"] > 1, np.sqrt(np.maximum(s["y2"], 0) / (s["n"] - 1)), np.nan)
        covariance = s["c"] / s["n"] + (s["pm"] - s["tm"]) * s["ym"]
        known = (s["n"] > 0) & (s["rows"] > 1) & (s["t2"] > 0)
        return np.where(known, covariance / (s["t2"] / (s["rows"] - 1)), np.nan)


def _joint(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = a + b
    return total, np.divide(b, total, out=np.zeros_like(total), where=total > 0)


def merge(a: State, b: State) -> State:
    n, share = _joint(a["n"], b["n"])
    out = {"n": n}
    if "ym" in a:
        dy = b["ym"] - a["ym"]
        out["ym"] = a["ym"] + dy * share
    if "y2" in a:
        out["y2"] = a["y2"] + b["y2"] + dy * dy * a["n"] * share
    if "rows" in a:
        out["rows"], row_share = _joint(a["rows"], b["rows"])
        dt, dp = b["tm"] - a["tm"], b["pm"] - a["pm"]
        out["tm"] = a["tm"] + dt * row_share
        out["t2"] = a["t2"] + b["t2"] + dt * dt * a["rows"] * row_share
        out["pm"] = a["pm"] + dp * share
        out["c"] = a["c"] + b["c"] + dp * dy * a["n"] * share
    if "low" in a:
        low, other = a["low"], b["low"]
        if low.dtype.kind == "f":
            return out | {"low": np.fmin(low, other), "high": np.fmax(a["high"], b["high"])}
        out["low"] = np.where(low == NONE, other, np.where(other == NONE, low, np.minimum(low, other)))
        out["high"] = np.maximum(a["high"], b["high"])
    return out


def prefixes(s: State, first: np.ndarray) -> State:
    """State of everything from place ``first`` up to and including each entry; ``first`` is the start of its group."""
    out, step = {k: v.copy() for k, v in s.items()}, 1
    place = np.arange(len(first))
    while len(at := np.flatnonzero(place - step >= first)):
        put(out, at, merge(take(out, at - step), take(out, at)))
        step *= 2
    return out


def suffixes(s: State, last: np.ndarray) -> State:
    """State of each entry and everything after it up to place ``last``; merging does not depend on the order."""
    size = len(last) - 1
    return take(prefixes(take(s, slice(None, None, -1)), (size - last)[::-1]), slice(None, None, -1))


def windows(s: State, start: np.ndarray, end: np.ndarray) -> State:
    """State of the entries ``start`` up to, not including, ``end`` of each window.

    Level j holds the state of the 2^j entries that end at each place; the binary digits of a window's length say which
    levels make it up, so a window costs as many merges as its length has digits.
    """
    out, at, left = empty_like(s, len(start)), end.copy(), end - start
    level, width = {k: v.copy() for k, v in s.items()}, 1
    size = len(s["n"])
    while (left > 0).any():
        uses = np.flatnonzero(left & width)
        if len(uses):
            put(out, uses, merge(take(level, at[uses] - 1), take(out, uses)))
            at[uses] -= width
            left[uses] -= width
        if width >= size:
            break
        joined = merge(take(level, slice(None, size - width)), take(level, slice(width, None)))
        put(level, slice(width, None), joined)
        width *= 2
    return out
