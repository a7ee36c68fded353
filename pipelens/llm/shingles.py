"""Hashed word shingles of whole texts, computed on the bytes of an Arrow column by numpy.

Bytes are handled CHUNK at a time. A longer text goes through in pieces; a word that a piece cuts is put together again,
so that hashes do not depend on where the cuts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once.
CHUNK = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _B)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_B, _B_INV)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Words:
    """Words of a run of texts: spans, hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE):
        n = len(data)
        space = breaks[data]
        word = ~space
        begins = word.copy()
        if n > 1:
            begins[1:] &= space[:-1]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begins[edges] = word[edges]
        self.start = np.flatnonzero(begins)
        ends = word.copy()
        if n:
            ends[:-1] &= space[1:]
            ends[-1] = word[-1]
        cut = edges - 1
        ends[cut] = word[cut]
        self.stop = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._up, self._down = _power(n)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[_LOWER[data]] * self._up[:n], out=self._sums[1:])

    def sums(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Polynomials of spans, with the first byte at power 0."""
        return (self._sums[stop] - self._sums[start]) * self._down[start]

    def span_hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix(self.sums(start, stop) + (stop - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.stop)


def long_hashes(data: np.ndarray, prefixes: tuple[int, ...] = (), breaks: np.ndarray = _SPACE) -> np.ndarray:
    """Hashes (words, 1 + prefixes) of the words of one text of any length, and of their first bytes."""
    sizes = (1 << 62, *prefixes)
    out: list[np.ndarray] = []
    open_sums, open_sizes = [0] * len(sizes), [0] * len(sizes)  # of a word that the last piece cut

    def close() -> None:
        if open_sizes[0]:
            out.append(mix(np.array([[(p + n) & _MASK for p, n in zip(open_sums, open_sizes)]], np.uint64)))
            open_sums[:], open_sizes[:] = [0] * len(sizes), [0] * len(sizes)

    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        words = Words(part, np.array([0, len(part)]), breaks)
        start, stop = words.start, words.stop
        if not len(start) or start[0] > 0:
            close()
        if not len(start):
            continue
        if open_sizes[0]:  # the first word goes on with the open one
            done = open_sizes[0]
            for j, most in enumerate(sizes):
                more = min(int(stop[0]), max(0, most - done))
                own = int(words.sums(np.array([0]), np.array([more]))[0])
                open_sums[j] = (open_sums[j] + own * pow(int(_B), open_sizes[j], 1 << 64)) & _MASK
                open_sizes[j] += more
            if stop[0] == len(part):
                continue
            close()
            start, stop = start[1:], stop[1:]
        if len(stop) and stop[-1] == len(part):
            for j, most in enumerate(sizes):
                end = np.minimum(stop[-1:], start[-1:] + most)
                open_sums[j], open_sizes[j] = int(words.sums(start[-1:], end)[0]), int(end[0] - start[-1])
            start, stop = start[:-1], stop[:-1]
        if len(start):
            out.append(np.stack([words.span_hash(start, np.minimum(stop, start + most)) for most in sizes], 1))
    close()
    return np.concatenate([np.zeros((0, len(sizes)), np.uint64), *out])


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about CHUNK bytes; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k neighbours of ``h``."""
    c = np.uint64(0xD6E8FEB86659FD93)
    n = len(h) - k + 1
    acc = np.full(max(0, n), np.uint64(k), np.uint64)
    for j in range(k if n > 0 else 0):
        acc = mix(acc * c + h[j : j + n])
    return acc


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of all words as one."""
    for _, data, offsets in texts_of(column):
        if len(data) > CHUNK:  # one text alone
            h = long_hashes(data)[:, 0]
            first = np.array([0, len(h)])
        else:
            words = Words(data, offsets)
            h, first = words.hashes(), words.first
        run = _runs(h, k)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                yield np.unique(run[a : b - k + 1])
            elif b > a:
                yield _runs(h[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)
