"""Vectorised words and n-grams of Arrow string arrays: numpy over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once (a longer text makes a chunk of its own).
CHUNK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random number for each byte at each of the first places of a word; later places are mixed from place and byte.
PLACES = 64
_AT = np.random.default_rng(20240607).integers(1, 1 << 64, PLACES * 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts of about CHUNK bytes; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK, "right")) - 1)
        to = min(to, n)
        yield at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


class Words:
    """The words of a chunk: doc, start, end (bytes) and, by ``hashes``, a 64-bit hash of each."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        n = len(data)
        inside = ~SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cuts - 1] = inside[cuts - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, off)  # words of doc d: bounds[d] to bounds[d + 1]
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.bounds))

    def hashes(self, fold_case: bool = False) -> np.ndarray:
        """A 64-bit hash of each word: the sum of random numbers of its bytes at their places, mixed with its length."""
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        byte = self.data[place + np.repeat(self.start, size)]
        code = place * 256 + (_LOWER[byte] if fold_case else byte)
        x = _AT[np.minimum(code, len(_AT) - 1)]
        far = np.flatnonzero(code >= len(_AT))
        x[far] = mix(mix(code[far].astype(np.uint64) + _AT[0]) + _AT[1])
        return mix(np.add.reduceat(x, first) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, for each place where n words are left (documents aren't told apart)."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)
