"""64-bit hashes of words and byte strings, vectorised, and equal on every machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once.
PIECE = 2_000_000
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a number over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 .. n - 1 modulo 2^64; the table of the usual size is kept."""
    if n > PIECE + 1:
        return _table(base, n)
    if base not in _POWERS:
        _POWERS[base] = _table(base, PIECE + 1)
    return _POWERS[base][:n]


def _table(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base & (1 << 64) - 1, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def prefix_sums(raw: np.ndarray, base: int = BASE) -> np.ndarray:
    """Sums of bytes times powers; a difference of two of them, shifted back, is the hash of the bytes between."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(base, len(raw)), out=out[1:])
    return out


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of at most ``PIECE`` bytes, cut at white space; a longer word stays whole."""
    start = 0
    while len(raw) - start > PIECE:
        end = max(raw.rfind(c, start, start + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end <= start:
            found = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := raw.find(c, start + 1)) > 0]
            end = min(found, default=len(raw))
        yield raw[start:end]
        start = end
    yield raw[start:]


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words between ASCII white space."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], (data != 32) & ((data < 9) | (data > 13)), [False]))
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    sums = prefix_sums(data)
    return starts, mix((sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts])


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text in turn, A-Z lower-cased; null has none."""
    waiting, size = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
        if waiting and size + len(raw) + 1 > PIECE:
            yield from _together(waiting)
            waiting, size = [], 0
        if len(raw) > PIECE:
            yield np.concatenate([_hash_piece(part)[1] for part in _pieces(raw)])
            continue
        waiting.append(raw)
        size += len(raw) + 1
    yield from _together(waiting)


def _together(raws: list[bytes]) -> Iterator[np.ndarray]:
    if not raws:
        return
    starts, hashes = _hash_piece(b"\n".join(raws))
    edges = np.cumsum([len(r) + 1 for r in raws])
    yield from np.split(hashes, np.searchsorted(starts, edges[:-1]))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of all words as one run where there are fewer."""
    if not len(words):
        return words
    runs = len(words) - width + 1
    taken, count = (width, runs) if runs > 0 else (len(words), 1)
    out = np.full(count, taken, np.uint64)
    for k in range(taken):
        out = mix(out + words[k:k + count])
    return np.unique(out)
