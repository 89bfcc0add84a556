"""Column-wise Burrows-Wheeler transform of a collection of byte strings.

The collection's transform and its common prefixes grow by one symbol of every
string a round: round j puts each string's suffix of length j into the sorted list
of all shorter suffixes. Where it goes follows from the rank of its first symbol in
the transform so far; its common prefix with its neighbours is one more than the
least of the old common prefixes between neighbouring equal symbols. Both sequences
live in temporary files of the task, read and written front to back once a round.
"""

from __future__ import annotations

import tempfile

import numpy as np


class _Sequence:
    """A sequence of numbers in a file without a name; it goes with the task."""

    def __init__(self, dtype):
        self.dtype, self.file = np.dtype(dtype), tempfile.TemporaryFile()

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.fromfile(self.file, self.dtype)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        values.tofile(self.file)
        self.file.truncate()

    def close(self) -> None:
        self.file.close()


def _least(values: np.ndarray):
    """Function giving the least of values[lo..hi], ends included, for arrays lo and hi."""
    n = len(values)
    levels = max(n.bit_length(), 1)
    table = np.empty((levels, n), values.dtype)  # row k: least of 2^k values from a place on
    table[0] = values
    for k in range(1, levels):
        half = 1 << (k - 1)
        np.minimum(table[k - 1, :n - half], table[k - 1, half:], out=table[k, :n - half])
    flat = table.ravel()

    def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo + 1).astype(np.float64))[1].astype(np.int64) - 1
        return np.minimum(flat[k * n + lo], flat[k * n + hi - (1 << k) + 1])
    return least


def symbol_windows(text: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Number the distinct runs of ``width`` symbols of strings of symbols 1, 2, ...

    Returns the class of every run, strings one after another and runs by their start,
    and where each string's runs begin (m + 1 places). Two runs have the same class if
    and only if they are the same. Every string has at least width symbols.
    """
    m = len(offsets) - 1
    size = np.diff(offsets)
    kind = text.dtype
    end = offsets[1:]
    rounds = int(size.max())
    transform, common = _Sequence(kind), _Sequence(np.uint8)
    try:
        transform.write(text[end - 1])  # before the empty suffix of each string stands its last symbol
        common.write(np.zeros(m, np.uint8))
        place = np.arange(m)
        for j in range(1, rounds + 1):
            b, lcp = transform.read(), common.read()
            n = len(b)
            order = np.argsort(b, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            whole = int(np.count_nonzero(b == 0))  # suffixes that are whole strings
            live = np.flatnonzero(size >= j)
            at = place[live]
            r = rank[at]
            to = m + r - whole
            sym = b[at]
            left = order[r - 1]
            after = np.minimum(r + 1, n - 1)
            right = order[after]
            same_left = (r > 0) & (b[left] == sym)
            same_right = (after > r) & (b[right] == sym)
            least = _least(lcp)
            here = np.zeros(len(live), np.uint8)
            here[same_left] = np.minimum(least(left[same_left] + 1, at[same_left]), width - 1) + 1
            there = np.minimum(least(at[same_right] + 1, right[same_right]), width - 1) + 1
            old = np.ones(n + len(live), bool)
            old[to] = False
            new = np.empty(n + len(live), kind)
            new[old] = b
            new[to] = np.where(size[live] > j, text[np.maximum(end[live] - j - 1, 0)], 0)
            transform.write(new)
            new = np.empty(n + len(live), np.uint8)
            new[old] = lcp
            new[to] = here
            new[to[same_right] + 1] = there
            common.write(new)
            place[live] = to
        b, lcp = transform.read(), common.read()
    finally:
        transform.close()
        common.close()
    # Walk every string once more through the finished transform, last symbol first.
    order = np.argsort(b, kind="stable")
    rank = np.empty(len(b), np.int64)
    rank[order] = np.arange(len(b))
    whole = int(np.count_nonzero(b == 0))
    number = np.cumsum(lcp < width)
    windows = np.concatenate(([0], np.cumsum(size - width + 1)))
    out = np.empty(int(windows[-1]), np.int64)
    place = np.arange(m)
    for j in range(1, rounds + 1):
        live = np.flatnonzero(size >= j)
        place[live] = m + rank[place[live]] - whole
        if j >= width:
            out[windows[live] + size[live] - j] = number[place[live]]
    return out, windows


def window_classes(data: np.ndarray, offsets: np.ndarray, width: int, block: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Number the distinct ``width``-byte windows of strings that each have at least width bytes.

    As ``symbol_windows``, but a symbol is ``block`` bytes (width is a multiple of it),
    which takes as many times fewer rounds. Each string then stands for ``block``
    strings of symbols, one for each remainder of a window's start.
    """
    m, n = len(offsets) - 1, len(data)
    size = np.diff(offsets)
    gram = np.zeros(n, np.uint64)
    for i in range(block):
        gram[:n - i] |= data[i:].astype(np.uint64) << np.uint64(8 * i)
    kinds, code = np.unique(gram, return_inverse=True)
    code = (code + 1).astype(np.uint16 if len(kinds) < 1 << 16 else np.uint32)
    shift = np.tile(np.arange(block), m)
    count = (np.repeat(size, block) - shift) // block
    kept = np.flatnonzero(count * block >= width)
    shift, count, first = shift[kept], count[kept], np.repeat(offsets[:-1], block)[kept]
    at = np.concatenate(([0], np.cumsum(count)))
    place = np.arange(at[-1]) - np.repeat(at[:-1], count)
    classes, begin = symbol_windows(code[np.repeat(first + shift, count) + place * block], at, width // block)
    windows = np.concatenate(([0], np.cumsum(size - width + 1)))
    out = np.empty(int(windows[-1]), np.int64)
    place = np.arange(len(classes)) - np.repeat(begin[:-1], np.diff(begin))
    to = windows[:-1][kept // block] + shift
    out[np.repeat(to, np.diff(begin)) + place * block] = classes
    return out, windows
