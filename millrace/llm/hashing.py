"""Vectorised word and shingle hashes of Arrow text columns, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed in one step; bounds a task's working memory.
STEP = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte, by rule.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
#: ASCII letters and digits.
WORD_BYTE = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: Fixed ranges of code points from U+0080 on: those that separate words, and those of scripts without spaces, of
#: which each character is a word. All others are parts of words.
GAPS = ((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2190, 0x2BFF), (0x2E00, 0x2E7F), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x303F), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0x1F000, 0x1FAFF))
SINGLE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x312F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, from 0 to n."""
    if not _powers or len(_powers[0]) <= n:
        n = max(n, STEP)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(b), np.uint64)], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with the hash of data[s:e] being (S[e] - S[s]) * inverse power of s."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data))[0][: len(data)], dtype=np.uint64, out=out[1:])
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text array; null is empty."""
    arr = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if len(arr) and arr.buffers()[2] else np.zeros(0, np.uint8)
    return data, off


def steps(off: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``step`` bytes; a longer row comes alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + step, "right")) - 1)
        yield lo, hi
        lo = hi


def _within(cp: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    flat = np.array(ranges).ravel()
    at = np.searchsorted(flat, cp, "right")
    return (at % 2 == 1) | (flat[np.maximum(at - 1, 0)] == cp)


def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte of UTF-8 text (0: gap, 1: part of a word, 2: of a word of one character), and whether a character starts there."""
    kind, lead = WORD_BYTE[data].astype(np.uint8), np.ones(len(data), bool)
    if not len(data) or data.max() < 128:
        return kind, lead
    lead = (data & 0xC0) != 0x80
    first = np.flatnonzero(lead & (data >= 0xC0))
    size = np.where(data[first] < 0xE0, 2, np.where(data[first] < 0xF0, 3, 4))
    cp = data[first].astype(np.int64) & (0xFF >> (size + 1))
    for k in (1, 2, 3):
        more = size > k
        cp[more] = cp[more] << 6 | (data[np.minimum(first[more] + k, len(data) - 1)] & 0x3F)
    kind[first] = np.where(_within(cp, GAPS), 0, np.where(_within(cp, SINGLE), 2, 1))
    return kind[np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))], lead


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word."""
    kind, lead = _classes(data)
    before, after = np.r_[np.uint8(0), kind], np.r_[kind, np.uint8(0)]
    fresh = np.r_[lead, True]
    s = np.flatnonzero((after == 2) & fresh | (after == 1) & (before != 1))
    e = np.flatnonzero((before == 2) & fresh | (before == 1) & (after != 1))
    sums = prefix_sums(data)
    return s, e, mix((sums[e] - sums[s]) * powers(len(data))[1][s])


def words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each word, hash of each word) over lower-cased texts, in order.

    A row of more than STEP bytes is hashed in pieces that end between words.
    """
    data, off = buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    for lo, hi in steps(off):
        part = data[off[lo] : off[hi]]
        if len(part) <= STEP:
            ends = off[lo : hi + 1] - off[lo]
            joined = np.insert(part, ends[1:-1], 32) if hi - lo > 1 else part  # a separator between rows
            s, _, h = _words(joined)
            shifted = ends[1:] + np.arange(hi - lo)
            yield lo, hi - lo, np.searchsorted(shifted, s, "right"), h
        else:
            found, at = [], 0
            while at < len(part):
                end = min(at + STEP, len(part))
                if end < len(part):
                    while end > at + 1 and part[end] & 0xC0 == 0x80:  # between characters
                        end -= 1
                    kind, _ = _classes(part[at:end])
                    gaps = np.flatnonzero(kind != 1)
                    end = at + int(gaps[-1]) + 1 if len(gaps) else end
                found.append(_words(part[at:end])[2])
                at = end
            h = np.concatenate(found)
            yield lo, 1, np.zeros(len(h), np.int64), h


def shingles(row: np.ndarray, word: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of n words; a row of fewer words is one shingle."""
    if not len(row):
        return row, word
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    counts = np.diff(np.r_[starts, len(row)])
    factor = np.uint64(_BASE)
    h = np.zeros(len(word), np.uint64)
    left = np.repeat(starts + counts, counts) - np.arange(len(word))  # words left in the row
    for k in range(n):
        ok = left > k
        h[ok] = h[ok] * factor + word[np.flatnonzero(ok) + k] + np.uint64(k + 1)
    keep = left >= np.minimum(n, np.repeat(counts, counts))
    short = np.repeat(counts, counts) < n
    keep &= ~short | (left == np.repeat(counts, counts))
    return row[keep], mix(h[keep])
