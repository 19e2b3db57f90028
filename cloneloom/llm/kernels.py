"""Vectorised text kernels over Arrow string batches.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. As those
are ASCII, words can be cut in the UTF-8 bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step holds; longer texts form a step alone.
STEP_BYTES = 1 << 20

WORDS_IN_SHINGLE = 5

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x.astype(_U, copy=True)
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_places = splitmix(np.arange(4096, dtype=_U)) | _U(1)


def place_keys(n: int) -> np.ndarray:
    """A fixed random odd multiplier for each of the first ``n`` byte places."""
    global _places
    if n > len(_places):
        _places = splitmix(np.arange(max(n, 2 * len(_places)), dtype=_U)) | _U(1)
    return _places


def steps(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, row bounds in them) of steps of a batch of
    texts; a null is empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + STEP_BYTES, "right")) - 1
        last = min(n, max(last, first + 1))
        own = bounds[first : last + 1]
        yield first, last - first, data[own[0] : own[-1]], own - own[0]
        first = last


@dataclass
class Words:
    """Words of a step: byte spans, hashes, and each row's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    row_at: np.ndarray


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that don't cross row bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit multilinear hashes of byte spans, mixed with their length."""
    length = end - start
    out = np.zeros(len(start), _U)
    full = length > 0
    if full.any():
        s, n = start[full], length[full]
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(at, n)
        values = (data[place + np.repeat(s, n)].astype(_U) + _U(1)) * place_keys(int(n.max()))[place]
        out[full] = np.add.reduceat(values, at)
    return splitmix(out ^ (length.astype(_U) << _U(40)))


def words(data: np.ndarray, bounds: np.ndarray, hashed: bool = True, space: np.ndarray = SPACE) -> Words:
    start, end = runs(~space[data], bounds)
    row = np.searchsorted(bounds, start, "right") - 1
    # rows without bytes share a bound with the next row; the last one holds it
    row_at = np.searchsorted(row, np.arange(len(bounds)))
    return Words(start, end, span_hashes(data, start, end) if hashed else np.zeros(0, _U), row, row_at)


def window_hashes(w: Words, size: int = WORDS_IN_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside a row, and the place of
    each window's first word."""
    n = len(w.hash)
    if n < size:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total = np.zeros(n - size + 1, _U)
    for k, key in enumerate(place_keys(size)[:size]):
        total += w.hash[k : n - size + 1 + k] * key
    first = np.flatnonzero(w.row[: n - size + 1] == w.row[size - 1 :])
    return splitmix(total[first]), first


def shingle_sets(texts: pa.Array, size: int = WORDS_IN_SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text.

    A text of fewer than ``size`` words, but one at least, has one shingle of
    all its words; a text without a word has none.
    """
    for first, n, data, bounds in steps(texts):
        w = words(data, bounds)
        hashes, at = window_hashes(w, size)
        cut = np.searchsorted(at, w.row_at)
        for k in range(n):
            own = hashes[cut[k] : cut[k + 1]]
            if not len(own) and w.row_at[k + 1] > w.row_at[k]:
                few = w.hash[w.row_at[k] : w.row_at[k + 1]]
                own = splitmix(np.add.reduce(few * place_keys(size)[: len(few)], keepdims=True) + _U(len(few)))
            yield first + k, np.unique(own)
