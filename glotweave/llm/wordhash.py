"""Vectorised word and shingle hashing over whole Arrow batches.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; as those are ASCII bytes the split is the same on
UTF-8 bytes and on code points.  Every word hash depends on the bytes of the word alone, so two executors agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.empty(_CHUNK, dtype=_U)
    out[0] = 1
    value = 1
    for i in range(1, _CHUNK):
        value = value * base & 0xFFFFFFFFFFFFFFFF
        out[i] = value
    return out


_POWERS: dict[int, np.ndarray] = {}


def _power_range(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept for the process up to 64 Ki entries."""
    if base not in _POWERS:
        _POWERS[base] = _powers(base)
    out = _POWERS[base]
    while len(out) < n:
        step = _U(pow(base, len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    return out[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, with a salt."""
    z = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


class Words:
    """The words of a batch of texts: hash per word, and where each text's words begin in the flat arrays.

    ``begin`` and ``end`` are byte offsets of the words in ``data``; ``first[i]:first[i + 1]`` are text i's words.
    Null texts have no words.
    """

    def __init__(self, texts: pa.Array, salt: int = 0):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.empty(0, np.uint8)
        offsets = offsets - (offsets[0] if n else 0)
        inside = ~_IS_SPACE[self.data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(self.data)]
        starts[cuts] = inside[cuts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        if len(self.data):
            ends[tails] = inside[tails]
        self.begin = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.hash = self._hashes(salt)

    def _hashes(self, salt: int) -> np.ndarray:
        """Polynomial hashes by differences of a running sum, in chunks that keep the work in cache."""
        out = np.empty(len(self.begin), dtype=_U)
        i = 0
        while i < len(self.begin):
            start = self.begin[i]
            j = max(i + 1, int(np.searchsorted(self.end, start + _CHUNK, "right")))
            stop = self.end[j - 1]
            n = int(stop - start)
            running = np.zeros(n + 1, dtype=_U)
            np.cumsum((self.data[start:stop].astype(_U) + _U(1)) * _power_range(_BASE, n), out=running[1:])
            b, e = self.begin[i:j] - start, self.end[i:j] - start
            out[i:j] = (running[e] - running[b]) * _power_range(_BASE_INVERSE, n)[b] + (e - b).astype(_U)
            i = j
        return mix(out, salt)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def words(self, a: int, b: int) -> bytes:
        """Words ``a`` to ``b`` of the flat arrays, joined by one space."""
        return b" ".join([self.data[x:y].tobytes() for x, y in zip(self.begin[a:b].tolist(), self.end[a:b].tolist())])

    def text_of(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Text i's words, or those that ``keep`` marks, joined by one space."""
        a, b = self.first[i], self.first[i + 1]
        begin, end = self.begin[a:b], self.end[a:b]
        if keep is not None:
            begin, end = begin[keep], end[keep]
        raw = self.data.tobytes() if len(self.data) < 4096 else memoryview(self.data)
        return b" ".join([bytes(raw[x:y]) for x, y in zip(begin.tolist(), end.tolist())])


def gram_hashes(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k words that begin at each position of one flat array; the last k - 1 positions are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    out = np.zeros(n, dtype=_U)
    for i in range(k):
        out = out * _U(_BASE) + hashes[i : i + n]
    return mix(out, salt + 1)


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions at which k words of one text begin, and the text of each."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    ahead = np.cumsum(counts) - counts
    return np.arange(len(text)) - ahead[text] + first[:-1][text], text
