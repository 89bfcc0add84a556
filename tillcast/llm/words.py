"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

# Byte kinds for segmentation: word bytes are letters, digits and all non-ASCII bytes.
_WORD = np.zeros(256, bool)
_WORD[ord("0"):ord("9") + 1] = True
_WORD[ord("A"):ord("Z") + 1] = True
_WORD[ord("a"):ord("z") + 1] = True
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters (two bytes, lead C3)."""
    out = _LOWER[data]
    if len(out) > 1:
        lat = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][lat] += 32
    return out


def powers(n: int) -> np.ndarray:
    """The first n powers of the multiplier."""
    p = np.full(n, _MUL)
    p[:1] = 1
    return np.multiply.accumulate(p)


class Words:
    """start, end (bytes) and 64-bit hash of each word; ``first``: each text's first word (n + 1 places)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, folded: np.ndarray | None = None):
        is_word = _WORD[data]
        edge = np.empty(len(data), bool)
        if len(data):
            edge[0] = is_word[0]
            np.greater(is_word[1:], is_word[:-1], out=edge[1:])
            inner = offsets[1:-1]
            inner = inner[inner < len(data)]
            edge[inner] = is_word[inner]  # words never cross texts
        self.start = np.flatnonzero(edge)
        run = np.flatnonzero(is_word)
        low = (fold(data) if folded is None else folded)[run]
        at = np.searchsorted(run, self.start) if len(run) else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(run)))
        self.end = self.start + size
        if len(run):
            place = np.arange(len(run)) - np.repeat(at, size)
            pw = powers(int(size.max()))
            self.hash = mix(np.add.reduceat(_BYTE[low] * pw[place], at))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, offsets)


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values in each of the runs first[i]..first[i + 1] (empty runs: 0)."""
    n = len(first) - 1
    out = np.zeros((n, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out
