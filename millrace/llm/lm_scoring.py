"""Cross-entropy difference of two matched n-gram models.

Both models share one vocabulary: every word that occurs at least MIN_COUNT times in all documents; all other
words are one token. Each is a bigram model interpolated with its unigram model; a bigram's count is backed by
its unigram probability, and after a rare word, or at a text's start, the unigram model stands alone. The
background's counts are scaled to the target's number of tokens, so that the same smoothing weighs alike in
both. A document's score is its loss per token under the background less its loss under the target: the
higher, the closer to the target.

Texts are tokenised once and never shuffled, into blocks of about HELD tokens that keep each token as a number of the
block's own list of words; the ids of its texts meet the target's ids apart. A block asks how often its words occur,
and when it knows the rare ones, for the counts of words and pairs on either side: each distinct one once, dealt by
hash to shares. A share adds up what the blocks bring and answers each in the order it asked,
so that a pair travels as a hash of eight bytes and its counts come back without it. No table is held whole: the
shares grow in number with the tokens, and a frequent pair is one key a block. Words are 64-bit hashes, pairs
64-bit hashes of two. A text is never cut, so a block may exceed HELD by one text.

Defined results: null and empty texts have 0 tokens, null losses and score 0; without target rows (or
background rows) both models are the same and every score is 0; repeated rows count as often as they occur.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, collect_plans, written

BIGRAM_WEIGHT, ADD = 0.7, 0.1
#: Words that occur less often are never in the vocabulary.
MIN_COUNT = 2
#: Keys that a share is meant to hold at most, hot ones (in many blocks) and others; LEAST where HOT is less.
HOT, LEAST = 1 << 21, 1 << 12
#: Tokens of a block (and cached word hashes of a task).
HELD = 2_000_000
CACHED = 500_000
_WORD = re.compile(r"\w+|[^\w\s]")
_ASKED = "pairs boolean, share bigint, block bigint, keys binary, counts binary"
_FOUND = "block bigint, pairs boolean, share bigint, found binary, kinds bigint"


def tokenise(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Hashes(dict):
    """Word to its 64-bit hash, which is never 0; holds a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little") or 1
        return h


class Codes(dict):
    """Word to its number in a block, by first occurrence; ``seen`` holds the words' hashes in that order."""

    def __init__(self, hashes: Hashes):
        self.hashes, self.seen = hashes, {}

    def __missing__(self, word: str) -> int:
        code = self[word] = self.seen.setdefault(self.hashes[word], len(self.seen))
        return code


def pack(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first, compressed: high bytes are mostly equal."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes, dtype: type) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    return np.frombuffer(pa.decompress(blob[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n).T.copy().view(dtype).ravel()


def pair_keys(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (h1 << np.uint64(1) | h1 >> np.uint64(63)) ^ h2


def blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_id, size, codes, words, kinds, tokens): texts as numbers of the block's words. ``docs`` has doc_id and text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            size, words = np.array([len(x) for x in held], np.int64), np.fromiter(codes.seen, np.uint64, len(codes.seen))
            row = {
                "doc_id": pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(ids)), "size": pa.array([size], pa.list_(pa.int64())),
                "codes": pa.array([pack(np.concatenate(held))]), "words": pa.array([pack(words)]), "kinds": pa.array([len(words)]), "tokens": pa.array([int(size.sum())]),
            }
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        hashes = Hashes()
        held, ids, tokens, codes = [], [], 0, Codes(hashes)
        for batch in batches:
            for k, text in enumerate(batch.column("text")):
                words = tokenise(text.as_py())
                held.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                ids.append(batch.column("doc_id").slice(k, 1))
                tokens += len(words) + 1
                if tokens > HELD:
                    yield flush()
                    held, ids, tokens, codes = [], [], 0, Codes(hashes)
        if held:
            yield flush()

    schema = f"doc_id array<{kind}>, size array<bigint>, codes binary, words binary, kinds bigint, tokens bigint"
    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    return rows.withColumn("block", F.monotonically_increasing_id())


class Block:
    """A row of :func:`blocks`, opened: each token's word, and the word before it (-1: none)."""

    def __init__(self, row: dict):
        self.block, self.words, self.codes = row["block"], unpack(row["words"], np.uint64), unpack(row["codes"], np.int32)
        self.size = np.array(row["size"], np.int64)
        self.stop = np.cumsum(self.size)
        self.full = self.size > 0
        self.before = np.roll(self.codes, 1)
        self.before[(self.stop - self.size)[self.full]] = -1
        self.order = np.argsort(self.words)

    def ask_words(self, shares: int) -> pa.Table:
        return asked(self.block, False, self.words[self.order], np.bincount(self.codes, minlength=len(self.words))[None, self.order], shares)

    def hear_words(self, answers: list[bytes], target: list[int]) -> None:
        """Now each token has a ``name`` (the rare words share one, of hash 0) and a side, and each that follows a common word a pair ``at``."""
        common = np.zeros(len(self.words), bool)
        common[self.order] = joined(answers, 1)[0] >= MIN_COUNT
        h = np.where(common, self.words, np.uint64(0))
        self.names, self.name = np.unique(h, return_inverse=True)
        self.after = np.flatnonzero((self.before >= 0) & common[self.before]) if len(self.codes) else np.zeros(0, np.int64)
        self.keys, self.at = np.unique(pair_keys(h[self.before[self.after]], h[self.codes[self.after]]), return_inverse=True)
        near = np.zeros(len(self.size), bool)
        near[target] = True
        self.near = np.repeat(near, self.size)

    def ask_counts(self, word_shares: int, pair_shares: int) -> pa.Table:
        """Times a word occurs on either side, and ends a text there; times a pair occurs there."""
        last = self.stop[self.full] - 1
        count = lambda what, near, n: [np.bincount(what[near == k], minlength=n) for k in (False, True)]
        used = self.name[self.codes]
        words = np.array(count(used, self.near, len(self.names)) + count(used[last], self.near[last], len(self.names)), np.int64)
        pairs = np.array(count(self.at, self.near[self.after], len(self.keys)), np.int64)
        return pa.concat_tables([asked(self.block, False, self.names, words, word_shares), asked(self.block, True, self.keys, pairs, pair_shares)])


def asked(block: int, pairs: bool, keys: np.ndarray, counts: np.ndarray, shares: int) -> pa.Table:
    """A block's sorted keys and their counts, a row for each share: shares are equal ranges of the hashes."""
    bounds = np.array([(k << 64) // shares for k in range(1, shares)], np.uint64)
    rows = [(pairs, k, block, pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(counts[:, a:b].ravel())) for k, (a, b) in enumerate(pairwise([0, *np.searchsorted(keys, bounds), len(keys)])) if a < b]
    return pa.table([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["pairs", "share", "block", "keys", "counts"])


def joined(answers: list[bytes], kinds: int) -> np.ndarray:
    """The shares' answers, in their order, as one array of ``kinds`` rows."""
    return np.concatenate([np.zeros((kinds, 0), np.int64), *(unpack(x, np.int64).reshape(kinds, -1) for x in answers)], axis=1)


def answered(rows: DataFrame) -> DataFrame:
    """Adds up each share's counts over all blocks, and answers every block in the order of its keys.

    A share's first row also tells of how many keys the first count reaches MIN_COUNT.
    """

    def run(share: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in share.column("keys").to_pylist()]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        at = np.split(at, np.cumsum([len(x) for x in keys])[:-1])
        sums = None
        for k, blob in zip(at, share.column("counts").to_pylist(), strict=True):
            counts = unpack(blob, np.int64).reshape(-1, len(k))
            sums = np.zeros((len(counts), len(every)), np.int64) if sums is None else sums
            sums[:, k] += counts  # a block's keys are distinct
        kinds = [int((sums[0] >= MIN_COUNT).sum()), *[0] * (len(at) - 1)]
        found = pa.array([pack(sums[:, k].ravel()) for k in at], pa.binary())
        return pa.table([*(share.column(c) for c in ("block", "pairs", "share")), found, pa.array(kinds, pa.int64())], names=["block", "pairs", "share", "found", "kinds"])

    return rows.groupBy("pairs", "share").applyInArrow(run, _FOUND)


def _shares(n: int) -> int:
    return 1 + n // max(HOT, LEAST)


def _answers(told: pa.Table, step: str) -> list[bytes]:
    rows = [r for r in told.select(["step", "share", "found"]).to_pylist() if r["step"] == step]
    return [r["found"] for r in sorted(rows, key=lambda r: r["share"])]


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text); rows whose id is among ``target_ids`` train the target model, all others the background.

    Gives (doc_id, n_tokens, loss_background, loss_target, score). The join with the ids is a merge join at every size: they have no bound.
    """
    bounded_batches(docs.sparkSession)
    table = written(blocks(docs), "blocks", dictionary=False)
    ids = target_ids.select("doc_id").where("doc_id is not null").distinct()
    texts = table.select("block", F.posexplode(F.arrays_zip("doc_id", "size")).alias("at", "text")).select("block", "at", "text.*")
    marks = written(texts.hint("merge").join(ids, "doc_id", "left_semi").groupBy("block").agg(F.collect_list("at").alias("target"), F.sum("size").alias("size")), "marks")
    tokens, listed = table.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds")]).first()
    size1 = marks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    size0 = tokens - size1
    word_shares, pair_shares = _shares(4 * listed), _shares(tokens)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield from Block(batch.slice(k, 1).to_pylist()[0]).ask_words(word_shares).to_batches()

    known = table.select("block", "size", "codes", "words")
    words = written(answered(known.mapInArrow(ask_words, _ASKED)), "words", dictionary=False)
    kinds = words.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]

    def opened(row: pa.Table, told: pa.Table) -> Block:
        b = Block(row.to_pylist()[0])
        b.hear_words(_answers(told, "rare"), [x for r in told.column("target").to_pylist() for x in r or ()])
        return b

    def ask_counts(row: pa.Table, told: pa.Table) -> pa.Table:
        return opened(row, told).ask_counts(word_shares, pair_shares)

    none = F.lit(None)
    told = words.select("block", F.lit("rare").alias("step"), "share", "found", none.cast("array<int>").alias("target"))
    told = told.union(marks.select("block", F.lit("mark"), none.cast("bigint"), none.cast("binary"), "target"))
    counts = written(answered(known.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask_counts, _ASKED)), "counts", dictionary=False)
    collect_plans(docs.sparkSession)

    both = not size0 or not size1  # one side is missing: both are the sum
    scaled = lambda x: [x[0] + x[1]] * 2 if both else [x[0] * (size1 / size0), x[1]]
    total = (size0 + size1 if both else size1) + ADD * (kinds + 1)

    def score(row: pa.Table, told: pa.Table) -> pa.Table:
        b = opened(row, told)
        word, n = joined(_answers(told, "word"), 4), scaled(joined(_answers(told, "pair"), 2))
        out = []
        for uses, follows, met in zip(scaled(word[:2]), scaled(word[:2] - word[2:]), n, strict=True):
            p = ((uses + ADD) / total)[b.name[b.codes]]
            tail = p[b.after]
            p[b.after] = (1 - BIGRAM_WEIGHT) * tail + BIGRAM_WEIGHT * (met[b.at] + ADD * tail) / (follows[b.name[b.before[b.after]]] + ADD)
            sums = np.full(len(b.size), np.nan)
            if b.full.any():
                sums[b.full] = np.add.reduceat(-np.log(p), (b.stop - b.size)[b.full]) / b.size[b.full]
            out.append(pa.array(sums, mask=~b.full))
        gap = pa.array(np.where(b.full, out[0].to_numpy(False) - out[1].to_numpy(False), 0.0))
        return pa.table([row.column("doc_id").combine_chunks().flatten(), pa.array(b.size), *out, gap], names=["doc_id", "n_tokens", "loss_background", "loss_target", "score"])

    told = told.union(counts.select("block", F.when(F.col("pairs"), "pair").otherwise("word"), "share", "found", none.cast("array<int>")))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, loss_background double, loss_target double, score double"
    return table.select("block", "doc_id", "size", "codes", "words").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema)
