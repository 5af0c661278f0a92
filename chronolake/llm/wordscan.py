"""Words of many texts at once: byte classes, word bounds and 64-bit word hashes in numpy."""

from __future__ import annotations

import numpy as np

from .common import LOWER

_P = 0x9E3779B97F4A7C15
_LOWER_TABLE = np.frombuffer(LOWER, np.uint8)
#: Bytes of decontamination words: digits, lower-case ASCII letters, and all of non-ASCII text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of white-space separated words.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Length up to which powers are kept: more than the usual piece of text.
LONGEST = 3 << 18
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64; those for usual lengths are kept, longer ones are made anew."""
    if n > LONGEST:
        return _powers_to(n)
    if not _powers:
        _powers.extend(_powers_to(LONGEST))
    return _powers[0], _powers[1]


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashed:
    """Prefix sums from which the hash of any byte range follows."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * up[: len(data)], out=self.total[1:])

    def ranges(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mixed64((self.total[stops] - self.total[starts]) * self.down[starts])


def bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of bytes inside, cut where a text ends."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(body: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """Lower-cased bytes, word starts and ends in them, word hashes, and each text's first word.

    offsets has one more entry than there are texts; so has the returned array of first words.
    """
    low = _LOWER_TABLE[body]
    if len(low) == 0:
        none = np.zeros(0, np.int64)
        return low, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, stops = bounds(kind[low], offsets)
    return low, starts, stops, Hashed(low).ranges(starts, stops), np.searchsorted(starts, offsets)
