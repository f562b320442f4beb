"""Runs of consecutive words that repeat with a period: boiler-plate loops, stuck generators, copied table rows.

A run is a maximal stretch of words with smallest period q that is at least ``min_length`` words and
``min_exponent`` periods long. Runs come from the Lyndon words of the text: for each of the two orders (words by
code, and the reverse; the end of the text is smallest in both) a stack scanned from right to left gives the next
smaller suffix of each place, which ends the longest Lyndon word there; every run has such a word as its root.
Suffixes are compared, and roots extended to both sides, by a longest common extension: rolling hashes and binary
search propose its length, and the words themselves are then compared, so that no answer rests on a hash. What was
compared at one distance is remembered, so a stretch of words is verified once for each distance.

Only stretches that can hold a run are scanned. In a run of period q, each three-word window that starts q words
or more after its start equals the window q words before. So a stretch of consecutive windows with an earlier
equal one is as long as the run but for its first q places, or there is no run; and its distances to the last
equal window are q at most. Both are necessary conditions: no run is lost, and texts without repetition cost one
pass of array operations.

Defined results: a null text has no words; words are separated by ASCII white space; rows are judged one by one,
so repeated rows and null ids get results of their own; an empty table gives none. Only the id and the text are
read, further columns of any name are not. A very long text is held, as words, by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, powers, steps

SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
#: Words of a window of the filter; two places nearer than NEAR are compared directly.
GRAM, NEAR = 3, 32
#: Bytes of text taken in one step.
STEP = 1 << 20
_MASK = (1 << 64) - 1
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Extensions:
    """Longest common extensions of places of one word list, to the right and to the left."""

    def __init__(self, codes: np.ndarray):
        self.w: list[int] = codes.tolist()
        self.n = len(self.w)
        self.power = powers(self.n)[0][: self.n + 1].tolist()
        sums = np.zeros(self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * powers(self.n)[0][: self.n], dtype=np.uint64, out=sums[1:])
        self.sums: list[int] = sums.tolist()
        self.seen: dict[int, tuple[int, int]] = {}

    def _alike(self, i: int, j: int, k: int) -> bool:
        s = self.sums
        return ((s[i + k] - s[i]) * self.power[j - i] - s[j + k] + s[j]) & _MASK == 0

    def _first_difference(self, i: int, j: int, k: int) -> int:
        """The first of k places where the words differ, or k."""
        w = self.w
        if w[i : i + k] == w[j : j + k]:
            return k
        return next(m for m in range(k) if w[i + m] != w[j + m])

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j; exact."""
        d, most = j - i, self.n - j
        at, known = self.seen.get(d, (-1, 0))
        if i <= at <= i + NEAR:  # the answer at ``at`` holds as soon as the words before it are equal
            k = self._first_difference(i, j, at - i)
            k = k + known if k == at - i else k
        else:
            lo, hi = 0, 1
            while hi <= most and self._alike(i, j, hi):
                lo, hi = hi, 2 * hi
            hi = min(hi, most + 1)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if self._alike(i, j, mid) else (lo, mid)
            if i <= at < i + lo:
                k = self._first_difference(i, j, at - i)
                k = k + known if k == at - i else k
            else:
                k = self._first_difference(i, j, lo)
        self.seen[d] = (i, k)
        return k

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j, i < j; exact."""
        lo, hi = 0, 1
        while hi <= i and self._alike(i - hi, j - hi, hi):
            lo, hi = hi, 2 * hi
        hi = min(hi, i + 1)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self._alike(i - mid, j - mid, mid) else (lo, mid)
        w = self.w
        if w[i - lo : i] == w[j - lo : j]:
            return lo
        return next(m for m in range(lo) if w[i - 1 - m] != w[j - 1 - m])


def runs_of(codes: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a word list, by start and period."""
    ext = Extensions(codes)
    w, n, roots = ext.w, ext.n, {}
    for sign in (1, -1):
        after = [n] * n
        ext.seen.clear()
        for i in range(n - 1, -1, -1):
            j, x, k = i + 1, w[i], 0
            while j < n:
                y = w[j]
                if x != y:
                    k = 0
                    if (x > y) == (sign > 0):
                        break
                else:
                    k = ext.right(i, j)
                    if j + k == n or (w[i + k] > w[j + k]) == (sign > 0):
                        break
                j = after[j]
            after[i] = j
            # the first root of a run starts in its first period, and is followed by all but two of its periods
            if j < n and k > (min_exponent - 2) * (j - i):
                roots[j - i, j + k] = min(i, roots.get((j - i, j + k), i))
    found = set()
    for (q, end), i in roots.items():
        start = i - ext.left(i, i + q)
        if end - start >= max(min_length, min_exponent * q):
            found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(flags: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each longest stretch of set flags within a row."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.r_[True, row[1:] != row[:-1]]
    s = np.flatnonzero(flags & (fresh | ~np.r_[False, flags[:-1]]))
    e = np.flatnonzero(flags & np.r_[fresh[1:] | ~flags[1:], True]) + 1
    return s, e


def _segments(codes: np.ndarray, row: np.ndarray, bounds: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(row, from, to): disjoint pieces that hold every run with the words around it."""
    e = min_exponent
    least = min(max(min_length, e * q) - q - GRAM + 1 for q in range(1, min_length + 2))
    if least < 1 or e < 2:
        return [(r, int(bounds[r]), int(bounds[r + 1])) for r in range(len(bounds) - 1) if bounds[r + 1] > bounds[r]]
    n = len(codes)
    if n < GRAM:
        return []
    with np.errstate(over="ignore"):
        key = mix(row[: n - GRAM + 1].astype(np.uint64) + np.uint64(1))
        for k in range(GRAM):
            key = mix(key * np.uint64(31) + codes[k : n - GRAM + 1 + k].astype(np.uint64))
    whole = row[: n - GRAM + 1] == row[GRAM - 1 :]
    key[~whole] = np.flatnonzero(~whole).astype(np.uint64)  # windows across rows: told apart, and not counted
    code = pa.array(key).dictionary_encode().indices.to_numpy()
    seen = np.maximum.accumulate(code)
    again = whole & (code <= np.r_[np.int32(-1), seen[:-1]])
    s, t = _stretches(again, row[: len(again)])
    rows = np.zeros(len(bounds) - 1, bool)
    rows[row[s[t - s >= least]]] = True
    if not rows.any():
        return []
    at = np.flatnonzero(rows[row[: len(again)]])
    order = at[np.argsort(code[at], kind="stable")]
    last = np.full(len(again), -n, np.int64)
    same = code[order[1:]] == code[order[:-1]]
    last[order[1:][same]] = order[:-1][same]
    gap = np.arange(len(again)) - last
    for _ in range(2):  # a window whose last equal one is farther than any period of its stretch ends the stretch
        again &= rows[row[: len(again)]]
        s, t = _stretches(again, row[: len(again)])
        limit = np.zeros(len(again), np.int64)
        for a, b in zip(s, t):
            limit[a:b] = (b - a + GRAM - 1) // (e - 1) if b - a >= least else -1
        again &= gap <= limit
    out: list[tuple[int, int, int]] = []
    for a, b in zip(*_stretches(again, row[: len(again)])):
        if b - a < least:
            continue
        r = int(row[a])
        lo, hi = max(int(bounds[r]), a - (b - a + GRAM - 1) // (e - 1) - 1), min(int(bounds[r + 1]), b + GRAM)
        if out and out[-1][0] == r and lo <= out[-1][2]:
            lo, hi = min(lo, out[-1][1]), max(hi, out[-1][2])
            out.pop()
            while out and out[-1][0] == r and lo <= out[-1][2]:
                lo = min(lo, out.pop()[1])
        out.append((r, int(lo), int(hi)))
    return out


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the rows, and where each row's words begin and end."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, sizes = parts.flatten(), np.asarray(pc.list_value_length(parts))
    some = np.asarray(pc.not_equal(flat, ""))
    row = np.repeat(np.arange(len(sizes)), sizes)[some]
    return flat.filter(pa.array(some)), np.r_[0, np.cumsum(np.bincount(row, minlength=len(sizes)))]


def _of_rows(texts: pa.Array, min_length: int, min_exponent: int) -> tuple[np.ndarray, list, list]:
    words, bounds = _words(texts)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    runs: list[list[dict]] = [[] for _ in range(len(texts))]
    keep = np.ones(len(words), bool)
    for r, lo, hi in _segments(codes, row, bounds, min_length, min_exponent):
        for start, length, q in runs_of(codes[lo:hi], min_length, min_exponent):
            keep[lo + start + q : lo + start + length] = False
            runs[r].append({"start": lo + start - int(bounds[r]), "length": length, "period": q})
    for found in runs:
        found.sort(key=lambda x: (x["start"], x["period"]))
    ends = np.r_[0, np.cumsum(keep)][bounds]
    kept = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words.filter(pa.array(keep)))
    return np.diff(bounds), runs, pc.binary_join(kept, pa.scalar(" ", pa.large_string()))


def find_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every run of each text by start and period, and the text with only the first
    period of each run, its words joined by single spaces. One pass over the rows, no shuffle."""
    if min_length < 2 or min_exponent < 2:
        raise ValueError("a run has two words and two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("t"), "").cast(pa.large_string())
            off = np.r_[0, np.cumsum(np.asarray(pc.binary_length(texts)))]
            for lo, hi in steps(off, STEP):
                n, runs, collapsed = _of_rows(texts.slice(lo, hi - lo), min_length, min_exponent)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), collapsed.cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, SCHEMA)
