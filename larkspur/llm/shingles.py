"""Sets of word shingles as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

#: Words in a shingle.
WIDTH = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    if n:
        out[:] = np.uint64(base)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_UP = 0xD1342543DE82EF95
_POWERS = {"up": _powers(_UP, 1 << 16), "down": _powers(_inverse(_UP), 1 << 16)}


def _table(which: str, n: int) -> np.ndarray:
    if len(_POWERS[which]) < n:
        _POWERS[which] = _powers(_UP if which == "up" else _inverse(_UP), 2 * n)
    return _POWERS[which]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text) of texts that lie end to end in the bytes of data, from starts[i] to starts[i + 1]."""
    n = len(data)
    space = _SPACE[data]
    inside = ~space
    edge = np.empty(n + 1, dtype=bool)
    edge[0], edge[n] = False, False
    edge[1:n] = space[: n - 1]
    first = inside.copy()
    if n:
        first[0] = inside[0]
        first[1:] &= space[:-1]
    cut = starts[:-1][starts[:-1] < n]
    first[cut] |= inside[cut]
    begin = np.flatnonzero(first)
    last = inside.copy()
    if n:
        last[:-1] &= space[1:]
    before = starts[1:] - 1
    before = before[(before >= 0)]
    last[before] |= inside[before]
    end = np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _table("up", n)[:n], out=sums[1:])
    words = mix((sums[end] - sums[begin]) * _table("down", n)[begin] + (end - begin).astype(np.uint64) * _ODD)
    return words, np.searchsorted(begin, starts)


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i has the distinct hashes[bounds[i]:bounds[i + 1]], sorted.

    A text with fewer words than a shingle, but some, has its whole sequence as one; a text without words has none.
    """
    words, at = word_hashes(data, starts)
    count = np.diff(at)
    rows = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    owner = np.repeat(np.arange(len(count)), rows)
    offset = np.concatenate([[0], np.cumsum(rows)])
    where = at[:-1][owner] + (np.arange(int(offset[-1])) - offset[:-1][owner])
    length = np.minimum(count, width)[owner]
    total = np.zeros(len(where), dtype=np.uint64)
    for k in range(width):
        on = length > k
        if on.all():
            total = mix(total * _MIX2 + words[where + k])
        else:
            total[on] = mix(total[on] * _MIX2 + words[where[on] + k])
    total = mix(total + length.astype(np.uint64) * _ODD)
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    keep = np.ones(len(total), dtype=bool)
    if len(total):
        keep[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    total, owner = total[keep], owner[keep]
    return total, np.searchsorted(owner, np.arange(len(count) + 1))
