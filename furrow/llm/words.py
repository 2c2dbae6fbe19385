"""Whole Arrow text columns turned into word hashes, without a Python loop over words.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. UTF-8
continuation bytes lie outside both ranges, so bytes and code points agree. Words and
shingles are identified by 64-bit hashes: two different words of one corpus share a hash
with probability about V^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
CHUNK_BYTES = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1:] * _STEP)])
    return _POWERS


def utf8_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, NULL as empty, offsets from 0."""
    col = col.cast(pa.large_string()).fill_null("") if col.null_count else col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if len(off) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or a single longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, word offsets per row) for consecutive rows."""
    base = off - off[0]
    data = data[off[0] : off[-1]]
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[base] = True
    starts = solid.copy()
    if len(data):
        starts[1:] &= ~solid[:-1] | first[1 : len(data)]
    at = np.flatnonzero(starts)
    rows = np.searchsorted(at, base)
    if not len(at):
        return np.zeros(0, np.uint64), rows
    begin = (np.cumsum(solid) - 1)[at]
    packed = data[solid]
    length = np.diff(np.append(begin, len(packed)))
    place = np.arange(len(packed), dtype=np.int64) - np.repeat(begin, length)
    value = (LOWER[packed] + np.uint64(1)) * _powers(int(length.max()))[place]
    h = np.add.reduceat(value, begin)
    return mix(h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words per row; a row of 1 to k-1 words gives one hash of all of them.

    The length is hashed too, so a short row never equals a shingle.
    """
    n = np.diff(rows)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    start = np.repeat(rows[:-1] - out[:-1], count) + np.arange(out[-1])
    span = np.repeat(np.minimum(n, k), count)
    h = np.full(len(start), 0x51_7C_C1_B7_27_22_0A_95, np.uint64) + span.astype(np.uint64)
    for j in range(k):
        inside = span > j
        if inside.all():
            h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[start + j])
        else:
            h[inside] = mix(h[inside] * np.uint64(0x2545F4914F6CDD1D) + words[start[inside] + j])
    return h, out
