"""Vector, full-text and hybrid retrieval over log windows."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import terms
from ..sources.scratch import written

if TYPE_CHECKING:
    from .text_index import TextIndex


def knn(items: DataFrame, query: list[float], k: int = 30, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) of the k nearest by cosine; rows without a vector are left out; ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = items.where(F.col(vector).isNotNull()).select(key, F.round(V.cosine(F.col(vector), q), 6).alias("similarity"))
    return scored.orderBy(F.desc_nulls_last("similarity"), key).limit(k)


#: Queries, and items, of one step of an exact search; shares that the items are dealt to.
QUERY_BLOCK, ITEM_BLOCK, SHARES = 512, 4096, 64


def knn_all(items: DataFrame, queries: DataFrame, k: int = 30, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(query, key, similarity): the k nearest items by cosine of every query, exactly; ties by key.

    Items are dealt to shares and every query goes to each share. A share's items come first and are held, a SHARES-th of them;
    its queries follow as a stream, and from each share only a query's k best go on.
    """
    kind, d = dict(items.dtypes)[key], F.array(*[F.lit(n) for n in range(SHARES)])
    rows = lambda df: df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    held = rows(items).select(F.pmod(F.xxhash64("k", "v"), F.lit(SHARES)).cast("int").alias("share"), F.lit(False).alias("asks"), "k", "v")
    asked = rows(queries).select(F.explode(d).alias("share"), F.lit(True).alias("asks"), F.col("k").cast(kind).alias("k"), "v")
    both = held.unionByName(asked).repartition("share").sortWithinPartitions("share", "asks")

    def unit(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(width, rows, unit vectors) of each width."""
        widths = np.asarray(column.value_lengths())
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            x = np.asarray(column.take(pa.array(at)).flatten(), float).reshape(len(at), w)
            yield int(w), at, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def nearest(share: dict[int, tuple[pa.Array, np.ndarray]], b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for w, at, q in unit(b.column("v")):
            if w not in share:
                continue
            keys, x = share[w]
            for lo in range(0, len(q), QUERY_BLOCK):
                part, rows, sims, best = q[lo : lo + QUERY_BLOCK], None, None, None
                for start in range(0, len(x), ITEM_BLOCK):  # the items are in the order of their keys, so ties go by key
                    s = np.round(part @ x[start : start + ITEM_BLOCK].T, 6)
                    n = np.broadcast_to(np.arange(start, start + s.shape[1]), s.shape)
                    s, n = (s, n) if sims is None else (np.hstack([sims, s]), np.hstack([rows, n]))
                    best = np.argsort(-s, 1, kind="stable")[:, :k]
                    sims, rows = np.take_along_axis(s, best, 1), np.take_along_axis(n, best, 1)
                who = pa.array(at[lo + np.repeat(np.arange(len(part)), sims.shape[1])])
                yield pa.RecordBatch.from_arrays([b.column("k").take(who), keys.take(pa.array(rows.ravel())), pa.array(sims.ravel())], names=["query", key, "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, share = None, [], None
        for batch in batches:
            for b in runs_of(batch, ["share", "asks"]):
                if b.column("share")[0].as_py() != now:
                    now, parts, share = b.column("share")[0].as_py(), [], None
                if not b.column("asks")[0].as_py():
                    parts.append(b.select(["k", "v"]))
                    continue
                if share is None:
                    share = {}
                    if parts:
                        table = pa.Table.from_batches(parts).combine_chunks()
                        table = table.take(pa.array(np.argsort(np.asarray(table.column("k")), kind="stable")))
                        keys = table.column("k").combine_chunks()
                        share = {w: (keys.take(pa.array(at)), x) for w, at, x in unit(table.column("v").combine_chunks())}
                    parts = []
                yield from nearest(share, b)

    return _top(both.mapInArrow(run, f"query {kind}, `{key}` {kind}, similarity double"), k, key)


def runs_of(b: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch cut where one of the columns changes."""
    if not b.num_rows:
        return
    values = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in columns])
    ends = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1
    for lo, hi in zip([0, *ends], [*ends, b.num_rows], strict=True):
        yield b.slice(int(lo), int(hi - lo))


def _top(near: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


@dataclass
class TextQuery:
    """A web-style query: alternatives joined by ``or``, each of words and phrases that must occur and others that must not.

    ``or`` binds less than what stands side by side; it is a word where nothing precedes or follows it.
    """

    alternatives: list[tuple[list[list[str]], list[list[str]]]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> TextQuery:
        tokens = [(minus, phrase, word, unit) for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text) if (unit := re.findall(r"[a-z0-9_]+", (phrase or word).lower()))]
        out, operand = cls(), False  # whether an operand stands before
        for n, (minus, phrase, word, unit) in enumerate(tokens):
            if operand and not minus and not phrase and word.lower() == "or" and n + 1 < len(tokens):
                out.alternatives.append(([], []))
                operand = False
                continue
            if not out.alternatives:
                out.alternatives.append(([], []))
            out.alternatives[-1][bool(minus)].append(unit)
            operand = True
        return out

    @classmethod
    def any_of(cls, words: list[str]) -> TextQuery:
        return cls([([[w]], []) for w in words])

    @property
    def words(self) -> list[str]:
        """Words that a match may hold, each once."""
        return list(dict.fromkeys(w for must, _ in self.alternatives for u in must for w in u))

    @property
    def operands(self) -> list[str]:
        """All words, excluded ones too: a rank is shared among them."""
        return list(dict.fromkeys(w for pair in self.alternatives for units in pair for u in units for w in u))

    @property
    def near(self) -> bool:
        """Whether the rank follows the distances between words: one alternative of several units, or of one phrase."""
        if len(self.alternatives) != 1 or len(self.operands) < 2:
            return False
        must, without = self.alternatives[0]
        return len(must) + len(without) > 1 or bool(must)


def _has(words: Column, unit: list[str]) -> Column:
    if len(unit) == 1:
        return F.array_contains(words, unit[0])
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(unit)} "))


def accepts(query: TextQuery, has: Callable[[list[str]], Column]) -> Column:
    """Whether one of the alternatives holds, by what tells whether a unit occurs."""
    out = F.lit(False)
    for must, without in query.alternatives:
        one = F.lit(True)
        for unit in must:
            one = one & has(unit)
        for unit in without:
            one = one & ~has(unit)
        out = out | one
    return out


def matches(words: Column, query: TextQuery) -> Column:
    return accepts(query, lambda unit: _has(words, unit))


#: Fixed values of the rank: the weight of a word, the limit of the sum of 1 / j^2, the places of a word that count, and
#: the last place that is told from later ones.
WEIGHT, ZETA, PLACES, LAST_PLACE = 0.1, 1.64493406685, 256, 16383


def places(words: Column, word: str) -> Column:
    """Places of a word, from 1."""
    return F.filter(F.transform(words, lambda w, i: F.when(w == word, i + 1)), lambda i: i.isNotNull())


def counted(at: Column) -> Column:
    """The places that count: PLACES at most, those beyond LAST_PLACE being one."""
    return F.slice(F.array_distinct(F.transform(at, lambda i: F.least(i, F.lit(LAST_PLACE)))), 1, PLACES)


def harmonic(n: Column) -> Column:
    """Sum of 1 / j^2 for j up to n."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, j: s + 1.0 / (j.cast("double") * j))).otherwise(0.0)


def by_count(counts: Column) -> Column:
    """Rank where any word may do, from the number of each operand's places: the mean of WEIGHT x harmonic / ZETA."""
    return F.aggregate(counts, F.lit(0.0), lambda s, n: s + harmonic(n)) * F.lit(WEIGHT / ZETA) / F.greatest(F.size(counts), F.lit(1))


def _weight(distance: int) -> float:
    """The weight of two words at a distance of 1 to 100; farther ones weigh less than a double can tell from nothing."""
    return WEIGHT * (1 / (1.005 + 0.05 * math.exp(distance / 1.5 - 2))) ** 0.5


#: The largest weight that two words can have: next to each other.
NEXT = _weight(1)


def by_distance(at: Column) -> Column:
    """Rank where words must meet, from the counted places of each operand: 1 less the product of 1 less each pair's weight."""
    rest = F.array(F.lit(1.0), *[F.lit(1 - _weight(d)) for d in range(1, 101)])  # words at one place have no weight
    pairs = lambda held, x, other: F.aggregate(other, held, lambda c, y: c * F.coalesce(F.get(rest, F.abs(x - y)), F.lit(1.0)))
    one = lambda held, i: F.aggregate(F.get(at, i), held, lambda a, x: F.aggregate(F.slice(at, F.lit(1), i), a, lambda b, other: pairs(b, x, other)))
    return 1 - F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(at) - 1, F.lit(0))), F.lit(1.0), one)


def rank_of(at: Column, near: Column | bool) -> Column:
    """Rank from the counted places of each operand, an array of arrays."""
    near = F.lit(near) if isinstance(near, bool) else near
    return F.round(F.when(near, by_distance(at)).otherwise(by_count(F.transform(at, lambda p: F.size(p)))), 6)


def with_rank(rows: DataFrame, at: Column, near: Column | bool) -> DataFrame:
    """Adds rank. The places are a column of their own first: the loops over them refer to them again and again."""
    return rows.withColumn("_at", at).withColumn("rank", rank_of(F.col("_at"), near)).drop("_at")


def places_of(words: Column, query: TextQuery) -> Column:
    return F.array(*[counted(places(words, w)) for w in query.operands]) if query.operands else F.array().cast("array<array<int>>")


def full_text(items: DataFrame, query: str, k: int = 30, key: str = "chunk_id", text: str = "content", any_word: bool = False) -> DataFrame:
    """(key, rank) of the k best matches; ``any_word`` asks for one of the words instead of all."""
    q = TextQuery.parse(query)
    q = TextQuery.any_of(q.words) if any_word and q.words else q
    rows = items.select(key, terms(F.col(text)).alias("_w")).where(matches(F.col("_w"), q))
    return with_rank(rows, places_of(F.col("_w"), q), q.near).select(key, "rank").orderBy(F.desc("rank"), key).limit(k)


def ranked_list(df: DataFrame, score: str, key: str, list_no: int) -> DataFrame:
    """Positions from 0; the list is at most a query's limit long, so one window holds it."""
    w = Window.partitionBy(F.lit(list_no)).orderBy(F.desc_nulls_last(score), key)
    return df.select(F.col(key).alias("key"), F.lit(list_no).alias("list_no"), (F.row_number().over(w) - 1).alias("position"))


def fuse(lists: list[DataFrame], limit: int = 30, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of :func:`ranked_list` results: sum of 1 / (k + position), earlier lists first."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    fused = every.groupBy("key").agg(F.round(F.sum(1.0 / (k + F.col("position"))), 6).alias("score"), F.min(F.struct("list_no", "position")).alias("_first"))
    return fused.orderBy(F.desc("score"), "_first").limit(limit).drop("_first")


def retrieve(items: DataFrame, query_text: str, query_vector: list[float] | None, limit: int = 30, key: str = "chunk_id", index: TextIndex | None = None) -> DataFrame:
    """Hybrid retrieval; only if both lists are empty does a match of any word count. With an ``index`` of the items no text is read."""
    near = knn(items, query_vector, limit, key) if query_vector else None
    search = partial(index.search, k=limit, key=key) if index else partial(full_text, items, k=limit, key=key)
    text = search(query_text)
    lists = ([ranked_list(near, "similarity", key, 0)] if near is not None else []) + [ranked_list(text, "rank", key, 1)]
    out = fuse(lists, limit)
    if out.isEmpty():
        out = fuse([ranked_list(search(query_text, any_word=True), "rank", key, 1)], limit)
    return out


def retrieve_all(items: DataFrame, query_text: str, queries: DataFrame, limit: int = 30, key: str = "chunk_id", text: str = "content", k: int = 60, index: TextIndex | None = None) -> DataFrame:
    """(query, key, score): hybrid retrieval with one text and every query vector."""
    near = knn_all(items, queries, limit, key).select("query", F.col(key).alias("key"), F.lit(0).alias("list_no"), F.col("similarity").alias("s"))
    found = (index.search(query_text, limit, key) if index else full_text(items, query_text, limit, key, text)).select(F.col(key).alias("key"), F.col("rank").alias("s"))
    words = queries.select(F.col(key).alias("query")).join(F.broadcast(found), F.lit(True)).select("query", "key", F.lit(1).alias("list_no"), "s")  # at most ``limit`` rows
    place = Window.partitionBy("query", "list_no").orderBy(F.desc("s"), "key")
    every = near.unionByName(words).withColumn("position", F.row_number().over(place) - 1)
    fused = every.groupBy("query", "key").agg(F.round(F.sum(1.0 / (k + F.col("position"))), 6).alias("score"), F.min(F.struct("list_no", "position")).alias("_first"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "_first")
    return fused.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= limit).drop("_r", "_first")


def retrieve_each(items: DataFrame, queries: DataFrame, index: TextIndex, limit: int = 30, key: str = "chunk_id", k: int = 60) -> DataFrame:
    """(query, key, score): :func:`retrieve` for every row (query, text, embedding) of ``queries``, in one run."""
    asked = queries.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(F.col("query").alias(key), "embedding")
    near = knn_all(items, asked, limit, key).select("query", F.col(key).alias("key"), F.lit(0).alias("list_no"), F.col("similarity").alias("s"))

    def words(rows: DataFrame, any_word: bool) -> DataFrame:
        return index.search_all(rows.select("query", "text"), limit, key, any_word).select("query", F.col(key).alias("key"), F.lit(1).alias("list_no"), F.col("rank").alias("s"))

    found = written(near.unionByName(words(queries, False)), "found")
    missed = written(queries.join(found.select("query").distinct(), "query", "left_anti"), "missed")
    if not missed.isEmpty():
        found = found.unionByName(words(missed, True))
    place = Window.partitionBy("query", "list_no").orderBy(F.desc_nulls_last("s"), "key")
    every = found.withColumn("position", F.row_number().over(place) - 1)
    fused = every.groupBy("query", "key").agg(F.round(F.sum(1.0 / (k + F.col("position"))), 6).alias("score"), F.min(F.struct("list_no", "position")).alias("_first"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "_first")
    return fused.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= limit).drop("_r", "_first")


def search_similar_chunks(chunks: DataFrame, documents: DataFrame, user_id, vector: list[float], limit: int = 10, document_ids: list | None = None) -> DataFrame:
    """Nearest chunks of a user's completed documents, optionally of some documents only."""
    docs = documents.where((F.col("user_id") == user_id) & (F.col("processing_status") == "COMPLETED"))
    if document_ids is not None:
        docs = docs.where(F.col("document_id").isin(document_ids))
    return knn(chunks.join(docs.select("document_id"), "document_id"), vector, limit)
