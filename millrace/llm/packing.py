"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Pieces are dealt by hash to shards of bounded size. Several islands evolve each shard, each in a task of its
own: a crossover injects whole well-filled bins of one parent into another, removes the duplicates that this
makes, and best-fits the displaced pieces. Between epochs the elite of each island migrates to the next island
of its shard. Then the weakest bins of neighbouring shards fall apart and their pieces evolve together, level
by level, so that the space that every shard wastes at its end is wasted once.

Defined results: a null or empty text is the single token that ends a document; a text with more tokens
than a sequence is cut, its first piece taking the remainder; repeated rows are packed as often as they
occur; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
#: Pieces of a shard, on average; bounds what one task evolves.
SHARD = 4096
#: Pieces of the weakest bins that a shard gives away, at most, and shards that give them to one new shard.
WEAKEST, MEET = 1024, 8
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 12, 4
WELL_FILLED = 0.998
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Ids as the named public tokenizer gives them, special tokens in the text included.

    The vocabulary's own rank file gives the same ids at a fifth of the time; runs of white space beyond what its
    regular expressions hold go to the tokenizer itself.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_tokenizers.path(name))
        ranks = {}
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            for line in f:
                word, rank = line.split()
                ranks[base64.b64decode(word)] = int(rank)
        special = {t.content: k for k, t in self.exact.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:
            return self.exact.encode(text, add_special_tokens=False).ids


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """Read once a worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                out += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids)))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


class _Bins:
    """Free space of open bins by amount; a bit set finds the tightest bin that fits in one step."""

    def __init__(self, free: np.ndarray, capacity: int):
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.next, self.capacity = 0, len(free), capacity
        for b, x in enumerate(free.tolist()):
            if x > 0:
                self.at[x].append(b)
                self.bits |= 1 << x

    def put(self, length: int) -> int:
        rest = self.bits >> length
        if rest:
            space = length + (rest & -rest).bit_length() - 1
            b = self.at[space].pop()
            if not self.at[space]:
                self.bits &= ~(1 << space)
        else:
            b, space = self.next, self.capacity
            self.next += 1
        if left := space - length:
            self.at[left].append(b)
            self.bits |= 1 << left
        return b


def best_fit(lengths: np.ndarray, order: np.ndarray, assign: np.ndarray, capacity: int) -> np.ndarray:
    """Places the items of ``order`` (assign -1) in that order; returns the assignment with bins renumbered."""
    placed = assign >= 0
    used, assign[placed] = np.unique(assign[placed], return_inverse=True)
    bins = _Bins(capacity - np.bincount(assign[placed], lengths[placed], len(used)).astype(np.int64), capacity)
    assign[order] = [bins.put(n) for n in lengths[order].tolist()]
    return assign


def _fitness(lengths: np.ndarray, assign: np.ndarray, capacity: int) -> tuple[int, float]:
    fill = np.bincount(assign, lengths) / capacity
    return -len(fill), float((fill**2).sum())


def _exchange(lengths: np.ndarray, assign: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """Swaps displaced pieces with smaller ones of bins that they fill better; returns what is displaced then."""
    pool = sorted(zip(lengths[loose].tolist(), loose.tolist(), strict=True))
    free = capacity - np.bincount(assign[assign >= 0], lengths[assign >= 0], int(assign.max(initial=-1)) + 1).astype(np.int64)
    inside = np.flatnonzero(assign >= 0)
    for k in inside[free[assign[inside]] > 0].tolist():
        room, mine = int(free[assign[k]]), int(lengths[k])
        at = bisect.bisect_right(pool, (mine + room, 1 << 62)) - 1
        if room and at >= 0 and pool[at][0] > mine:
            size, other = pool.pop(at)
            bisect.insort(pool, (mine, k))
            free[assign[k]] -= size - mine
            assign[other], assign[k] = assign[k], -1
    return np.array([k for _, k in pool], np.int64)


def _crossover(lengths: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(giver, lengths)
    good = np.flatnonzero(fill >= WELL_FILLED * capacity)
    if not len(good):
        good = np.flatnonzero(fill == fill.max())
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, len(good) // 2), replace=False)] = True
    injected = chosen[giver]
    broken = np.zeros(taker.max() + 1, bool)
    broken[taker[injected]] = True  # bins of the taker that hold an injected item fall apart
    child = np.where(injected, giver + len(broken), np.where(broken[taker], -1, taker))
    weak = rng.choice(len(lengths), max(1, len(lengths) // 100), replace=False)  # mutation: a few bins are emptied
    fills = np.bincount(child[child >= 0], lengths[child >= 0])
    low = weak[(child[weak] >= 0) & (fills[child[weak]] < WELL_FILLED * capacity)]
    child[np.isin(child, child[low]) & (child >= 0)] = -1
    loose = _exchange(lengths, child, np.flatnonzero(child < 0), capacity)
    noise = rng.integers(0, 8, len(loose))
    return best_fit(lengths, loose[np.argsort(-(lengths[loose] + noise), kind="stable")], child, capacity)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator, generations: int = GENERATIONS, size: int = POPULATION) -> list[np.ndarray]:
    """The best ``size`` assignments, best first; stops once a packing meets the lower bound."""
    bound = -(-int(lengths.sum()) // capacity)
    while len(population) < size:
        order = np.argsort(-(lengths + rng.integers(0, 1 + 16 * len(population), len(lengths))), kind="stable")
        population.append(best_fit(lengths, order, np.full(len(lengths), -1), capacity))
    rank = lambda x: _fitness(lengths, x, capacity)
    population = sorted(population, key=rank, reverse=True)
    for _ in range(generations):
        if -rank(population[0])[0] <= bound:
            break
        pairs = [rng.choice(len(population), 2, replace=False) for _ in range(size)] if len(population) > 1 else []
        population = sorted(population + [_crossover(lengths, population[a], population[b], capacity, rng) for a, b in pairs], key=rank, reverse=True)[:size]
    return population[:size]


def settle(lengths: np.ndarray, tags: np.ndarray, plan: np.ndarray, first: int, capacity: int, weakest: int) -> pd.DataFrame:
    """Rows (tag, length, sequence_id, offset, weak) of a packing; sequences are numbered from ``first``.

    The pieces of the least filled bins, at most ``weakest``, are weak: they may be packed again with others.
    """
    order = np.argsort(plan, kind="stable")
    size, used = lengths[order], plan[order]
    starts = np.cumsum(size) - size
    new = np.r_[True, np.diff(used) > 0]
    fill, count = np.bincount(plan, lengths), np.bincount(plan)
    by_fill = np.argsort(fill, kind="stable")
    weak = np.zeros(len(fill), bool)
    weak[by_fill[(np.cumsum(count[by_fill]) <= weakest) & (fill[by_fill] < capacity)]] = True
    return pd.DataFrame({"tag": tags[order], "length": size, "sequence_id": first + used, "offset": starts - starts[new][np.cumsum(new) - 1], "weak": weak[used]})


def _islands(part: DataFrame, shard: str, capacity: int, salt: int, weakest: int) -> DataFrame:
    """Evolves the pieces (tag, length) of each shard on ISLANDS islands, a task each; the elite migrates between epochs."""
    state = "shard bigint, island int, lengths binary, tags binary, plan binary"
    names = [x.split()[0] for x in state.split(", ")]

    def routed(shard: int, island: int, lengths: np.ndarray, tags: np.ndarray, found: list[np.ndarray]) -> pd.DataFrame:
        to = [(island, x) for x in found] + [((island + 1) % ISLANDS, found[0])]
        return pd.DataFrame([(shard, i, lengths.tobytes(), tags.tobytes(), x.astype(np.int64).tobytes()) for i, x in to], columns=names)

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "tag"], ascending=[False, True])
        lengths, at, island = pdf["length"].to_numpy(np.int64), int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
        return routed(at, island, lengths, pdf["tag"].to_numpy(np.int64), evolve(lengths, [], capacity, np.random.default_rng([at, island, salt])))

    def epoch(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        lengths, at, island = np.frombuffer(first["lengths"], np.int64), int(first["shard"]), int(first["island"])
        population = [np.frombuffer(x, np.int64).copy() for x in sorted(pdf["plan"])]
        found = evolve(lengths, population, capacity, np.random.default_rng([at, island, salt + 1]), size=max(POPULATION, len(population)))
        return routed(at, island, lengths, np.frombuffer(first["tags"], np.int64), found[:POPULATION])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        lengths = np.frombuffer(first["lengths"], np.int64)
        best = max((np.frombuffer(x, np.int64) for x in sorted(pdf["plan"])), key=lambda x: _fitness(lengths, x, capacity))
        return settle(lengths, np.frombuffer(first["tags"], np.int64), best, (salt << 52) + (int(first["shard"]) << 20), capacity, weakest).assign(shard=int(first["shard"]))

    rows = part.withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])))
    islands = rows.select(F.col(shard).alias("shard"), "island", "tag", "length").groupBy("shard", "island").applyInPandas(begin, state)
    for _ in range(EPOCHS - 1):
        islands = islands.groupBy("shard", "island").applyInPandas(epoch, state)
    return islands.groupBy("shard").applyInPandas(finish, "tag bigint, length bigint, sequence_id bigint, offset bigint, weak boolean, shard bigint")


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, weakest: int = WEAKEST, meet: int = MEET) -> DataFrame:
    """``items`` (as :func:`pieces` gives them, with a tag) with sequence_id and offset. ``items`` must be a written table."""
    part, full = items.where(F.col("length") < capacity), items.where(F.col("length") >= capacity)
    shards = max(1, -(-part.count() // shard))
    dealt = part.select("tag", "length", F.pmod(F.xxhash64("tag"), F.lit(shards)).alias("shard"))
    found, places, level = written(_islands(dealt, "shard", capacity, 0, weakest), "packed"), None, 0
    while True:
        last = shards == 1
        done = found.select("tag", "sequence_id", "offset") if last else found.where("not weak").select("tag", "sequence_id", "offset")
        places = done if places is None else places.unionByName(done)
        if last:
            break
        # the weakest bins of several shards fall apart and are packed together
        shards, level = -(-shards // meet), level + 1
        pool = found.where("weak").select("tag", "length", F.floor(F.col("shard") / meet).cast("bigint").alias("shard"))
        found = written(_islands(pool, "shard", capacity, level, weakest), "packed")
    placed = part.join(places, "tag").drop("tag")
    alone = full.select("*", (-1 - F.col("tag")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("tag")
    return placed.unionByName(alone)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(pieces(docs).withColumn("tag", F.monotonically_increasing_id()), "pieces"), capacity)
