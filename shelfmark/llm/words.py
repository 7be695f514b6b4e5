"""Words of whole texts as hashes, in numpy over UTF-8 buffers."""

from __future__ import annotations

import numpy as np

# A-Z lower-cased; words are ASCII digits, letters and everything outside ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(name: str, base: np.uint64, size: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < size, kept between calls."""
    have = _powers.get(name)
    if have is None or len(have) < size:
        have = np.full(max(size, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
    return have[:size]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text and at the end); words never cross texts."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    low = LOWER[data]
    inside = IN_WORD[low]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[filled] = inside[filled]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = inside[last]
    first, final = np.flatnonzero(starts), np.flatnonzero(ends)
    with np.errstate(over="ignore"):
        sums = np.cumsum(_LETTERS[low] * powers("base", _BASE, len(data)), dtype=np.uint64)
        found = sums[final] - np.where(first > 0, sums[first - 1], np.uint64(0))
        found = mixed(found * powers("inverse", _INVERSE, len(data))[first])
    return found, np.searchsorted(first, offsets).astype(np.int64)
