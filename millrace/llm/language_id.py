"""Language identification by multilingual mixture inference.

Every language has a distribution over hashed byte 4-grams of lower-cased letter runs. A document is a
mixture of languages; expectation-maximisation estimates the proportions, and the language set is the one
with the best penalised likelihood among the nested sets ordered by proportion.

The score is the predicted language's expected share, over the posterior of the sets (and, among sets of one
language, of the languages).

Defined results: a null text, or one without a letter, is ``und`` with score 0; a text with letters but
without a gram tells nothing, so it gets the language with most training grams and that language's share of
them as its score; with no training rows every document is ``und``; rows with null language train nothing;
texts of any length are counted whole, in blocks. Repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import remove, written

GRAM = 4
#: Size of the hashed gram space; bounds the model to languages x 65,536 numbers.
BUCKETS = 1 << 16
#: Cells of the (language x gram) work array of one step; bounds a task's memory.
WORK = 1_000_000
#: Bounds what the driver and each task hold: 128 languages.
MODEL_LIMIT_MB = 64
EM_STEPS, REFINE_STEPS = 8, 6
#: 4-grams overlap, so a likelihood counts each letter about four times; the penalty counts as often.
PENALTY = 0.5 * GRAM


def letter_runs(texts: pa.Array) -> pa.Array:
    """Lower case, with one space for each run of anything but letters, and at both ends."""
    kept = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pM]+", " ")
    return pc.binary_join_element_wise(pa.scalar(" "), kept, pa.scalar(" "), pa.scalar(""))


def _hash(data: np.ndarray) -> np.ndarray:
    b = data.astype(np.uint32)
    v = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    return (v * np.uint32(2654435761)) >> np.uint32(16)


def gram_counts(texts: pa.Array, step_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each distinct gram, gram, count), a bounded number of bytes at a time."""
    arr = letter_runs(texts).cast(pa.large_string())
    if not len(arr):
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + step_bytes, "right")) - 1)
        if off[hi] - off[lo] > step_bytes:  # one long text: counted block by block
            total = np.zeros(BUCKETS, np.int64)
            for s in range(int(off[lo]), int(off[hi]) - GRAM + 1, step_bytes):
                total += np.bincount(_hash(data[s : min(s + step_bytes + GRAM - 1, int(off[hi]))]), minlength=BUCKETS)
            found = np.flatnonzero(total)
            yield lo, 1, np.zeros(len(found), np.int64), found, total[found]
        else:
            part, ends = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            row = np.repeat(np.arange(hi - lo), np.diff(ends))
            if len(part) >= GRAM:
                same = row[: 1 - GRAM] == row[GRAM - 1 :]
                keys, n = np.unique(row[: 1 - GRAM][same] * BUCKETS + _hash(part)[same], return_counts=True)
                yield lo, hi - lo, keys // BUCKETS, keys % BUCKETS, n
            else:
                yield lo, hi - lo, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = hi


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Gram counts of each language over every row with a language: summed per task, then by one aggregate."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            for lo, rows, row, gram, n in gram_counts(batch.column("text"), WORK):
                for lang in set(langs[lo : lo + rows]):
                    mine = langs[lo + row] == lang
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    sums[lang] += np.bincount(gram[mine], n[mine], BUCKETS).astype(np.int64)
        for lang, total in sums.items():
            found = np.flatnonzero(total)
            # a language without a gram is still a language
            found = found if len(found) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(total[found])], names=["lang", "gram", "n"])

    rows = docs.where("lang is not null").select("text", "lang").mapInArrow(count, "lang string, gram int, n bigint")
    found = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = written(found, "grams")
    langs = sorted(r["lang"] for r in table.select("lang").distinct().limit((MODEL_LIMIT_MB << 20) // (BUCKETS * 8) + 1).collect())
    if len(langs) * BUCKETS * 8 > MODEL_LIMIT_MB << 20:
        raise ValueError(f"more languages than the model's {MODEL_LIMIT_MB} MB hold")
    model = {lang: np.zeros(BUCKETS, np.int64) for lang in langs}
    if langs:  # at most languages x BUCKETS rows, which MODEL_LIMIT_MB bounds
        cells = table.toPandas()
        for lang, rows_ in cells.groupby("lang"):
            model[lang][rows_["gram"].to_numpy()] = rows_["n"].to_numpy()
    remove(table)
    return model


def _em(p: np.ndarray, row: np.ndarray, n: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (rows x languages) and log likelihoods after so many steps from ``pi``."""
    rows = len(pi)
    total = np.maximum(np.bincount(row, n, rows), 1)
    for _ in range(steps):
        joint = pi.T[:, row] * p
        joint *= n / joint.sum(0)
        pi = np.stack([np.bincount(row, x, rows) for x in joint], 1) / total[:, None]
    return pi, np.bincount(row, n * np.log((pi.T[:, row] * p).sum(0)), rows)


def infer(p: np.ndarray, row: np.ndarray, n: np.ndarray, rows: int, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, expected): proportions over the languages of each row's selected set (zero elsewhere), and the
    proportions expected over the posterior of all sets. Rows without a gram expect ``prior``."""
    langs = len(p)
    full, bound = _em(p, row, n, np.full((rows, langs), 1 / langs), EM_STEPS)
    order = np.argsort(-full, 1, kind="stable")
    price = PENALTY * np.log(np.maximum(np.bincount(row, n, rows), 2))
    best, value = np.zeros((rows, langs)), np.full(rows, -np.inf)
    # sets of one language: each language's own likelihood; grams overlap, so a letter counts once in GRAM
    single = np.stack([np.bincount(row, n * np.log(x), rows) for x in p], 1) / GRAM
    expected = np.exp(single - single.max(1, keepdims=True)) * prior
    expected /= expected.sum(1, keepdims=True)
    weight, top = np.ones(rows), (single.max(1) * GRAM - price) / GRAM
    open_ = np.bincount(row, minlength=rows) > 0
    for size in range(1, langs + 1):  # nested sets; a row stops at its first set that doesn't pay
        use = open_[row]
        if not use.any():
            break
        new = np.cumsum(open_) - 1
        start = np.zeros((rows, langs))
        np.put_along_axis(start, order[:, :size], np.maximum(np.take_along_axis(full, order[:, :size], 1), 1e-3), 1)
        start = (start / start.sum(1, keepdims=True))[open_]
        pi, ll = _em(p[:, use], new[row[use]], n[use], start, REFINE_STEPS if size > 1 else 0)
        worth = ll - size * price[open_]
        at = np.flatnonzero(open_)
        if size > 1:
            more = np.exp(np.clip(worth / GRAM - top[at], -700, 700))
            expected[at] = (expected[at] * weight[at, None] + pi * more[:, None]) / (weight[at] + more)[:, None]
            weight[at] += more
        gain = worth > value[open_]
        best[at[gain]], value[at[gain]] = pi[gain], worth[gain]
        open_[at[~gain]] = False
        open_ &= bound + 1 - (size + 1) * price > value  # no larger set explains more than all languages do
    return best, expected


def identify(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str] = ["doc_id"], within: str | None = None) -> DataFrame:  # noqa: B006
    """The columns of ``keep`` with lang_pred, score (its expected share) and shares (language to share in the selected set).

    The text is the column text, or the field text of the struct ``within``, one of ``keep``, so that it is sent once.
    """
    langs = list(model)
    if not langs:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.expr("cast(map() as map<string,double>)").alias("shares"))
    counts = np.stack([model[x] for x in langs]).astype(np.float64) + 0.5
    seen = np.array([max(int(model[x].sum()), 1) for x in langs], float)
    prior = seen / seen.sum()
    prob = docs.sparkSession.sparkContext.broadcast(counts / counts.sum(1, keepdims=True))  # bounded: MODEL_LIMIT_MB

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = prob.value
        for batch in batches:
            texts = batch.column("text") if within is None else batch.column(within).field(at)
            shares, expected = np.zeros((len(texts), len(langs))), np.tile(prior, (len(texts), 1))
            for lo, rows, row, gram, n in gram_counts(texts, max(1 << 16, WORK // len(langs))):
                if len(gram):
                    shares[lo : lo + rows], expected[lo : lo + rows] = infer(p[:, gram], row, n, rows, prior)
            any_letter = np.array(pc.match_substring_regex(pc.fill_null(texts, ""), r"\pL"), bool)
            top = expected.argmax(1)
            score = np.where(any_letter, np.clip(expected[np.arange(len(top)), top], 0, 1), 0.0)
            names = [langs[t] if ok else "und" for t, ok in zip(top, any_letter, strict=True)]
            maps = [[(langs[j], float(s[j])) for j in np.flatnonzero(s > 0)] if ok else [] for s, ok in zip(shares, any_letter, strict=True)]
            columns = [batch.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(score), pa.array(maps, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "shares"])

    rows = docs.select(*dict.fromkeys([*keep, "text"] if within is None else keep))
    at = None if within is None else rows.schema[within].dataType.names.index("text")
    found = StructType.fromDDL("lang_pred string, score double, shares map<string,double>")
    return rows.mapInArrow(predict, StructType([*(rows.schema[c] for c in keep), *found.fields]))
