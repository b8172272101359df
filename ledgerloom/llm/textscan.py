"""Vectorised scans over the words and bytes of many texts at once."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n - 1 of the multiplier or of its inverse."""
    key = "i" if inverse else "p"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, BASE_INVERSE if inverse else BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS[key] = have = np.multiply.accumulate(p)
    return have[:n]


def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte, the same in every process."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_hash(raw: np.ndarray, values: np.ndarray) -> np.ndarray:
    """S with S[b] - S[a] = the sum of values[raw[i]] * BASE ** i over a <= i < b."""
    return prefix_of(values[raw])


def prefix_of(values: np.ndarray) -> np.ndarray:
    """The same for a 64-bit number at each place."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte string [start, end), wherever it stands."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), True)[start] + (end - start).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all 64 bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_VALUES = byte_values(7)


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last, text) of every word, a run without white space; bytes count from the text's own start."""
    raw = np.frombuffer(b"".join(t + b" " for t in texts), dtype=np.uint8)
    if not len(raw):
        z = np.zeros(0, dtype=np.int64)
        return z.view(np.uint64), z, z, z
    space = _SPACE[raw]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    who = np.searchsorted(ends, start, side="right")
    first = ends - np.array([len(t) + 1 for t in texts])
    return substring_hash(prefix_hash(raw, _VALUES), start, end), start - first[who], end - first[who], who


def word_shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and whose text each is from.

    Words are runs without white space; a text with fewer words gives one
    shingle of all of them, one without words gives none.
    """
    raw = np.frombuffer(b"".join(t + b" " for t in texts), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[raw]
    # One space between words, none before the first: shingles don't depend on white space.
    keep = ~space | np.r_[False, ~space[:-1]]
    owner_ends = np.cumsum(keep)[ends - 1]
    raw = np.where(space, 0x20, raw).astype(np.uint8)[keep]
    stop = np.flatnonzero(raw == 0x20)
    start = np.r_[0, stop[:-1] + 1] if len(stop) else stop
    owner = np.searchsorted(owner_ends, stop, side="right")
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    who = np.repeat(np.arange(len(texts)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    last = np.minimum(at + width, first[who] + n[who]) - 1
    prefix = prefix_hash(raw, _VALUES)
    return substring_hash(prefix, start[at], stop[last]), who
