"""A stored positional inverted index: posting lists by term, with the best of each block to skip by.

``build`` keeps, for each term and item, the term's positions; items are dealt into blocks by a hash of their key, and
for each term and block the largest number of occurrences is kept. A search reads the rows of its own words only.
It first learns from the blocks' numbers which blocks can match at all and what each could score at most; the most
promising blocks are evaluated, and of the others only those that could still reach the k best found so far.
Phrases are followed by positions, exclusions by the postings of the excluded words; no text is read.

The results are those of :func:`retrieval.full_text` over the same items. Defined results: an item with null text is
in no result; one without a word is only found by queries of exclusions alone; repeated keys are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..sources.scratch import written
from .retrieval import NEXT, PLACES, TextQuery, accepts, by_count, counted, with_rank

#: Items of a block on average, folders of postings, tasks that share a folder, blocks evaluated first.
BLOCK_ITEMS, BUCKETS, SALTS, FIRST = 4096, 64, 16, 32
_POSTINGS = "term string, block int, doc bigint, key {kind}, n int, positions array<int>, bucket int"
_BLOCKS = "term string, block int, most int, items bigint, bucket int"


#: Words of one step of the indexing: a batch of long texts is cut, so that its arrays stay small.
STEP_WORDS = 1 << 19


def _small(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_WORDS) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of whole rows whose lists hold ``most`` words together, a longer row being one."""
    for b in batches:
        ends, lo = np.cumsum(np.asarray(b.column(column).value_lengths())), 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """An index in a folder: ``items``, ``postings`` and ``blocks``, the last two by bucket of the term."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, items: DataFrame, path: str, key: str = "chunk_id", text: str = "content", block_items: int = BLOCK_ITEMS) -> TextIndex:
        """Index every item; what was in the folder is replaced."""
        out, spark = cls(items.sparkSession, path), items.sparkSession
        rows = items.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"))
        n_blocks = max(1, -(-rows.count() // block_items))
        # an item's number is fixed by this table, so that repeated keys stay apart
        rows.select(F.monotonically_increasing_id().alias("doc"), "key", "t").write.mode("overwrite").parquet(f"{out.path}/source")
        rows = spark.read.parquet(f"{out.path}/source").withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(n_blocks)).cast("int"))
        rows.select("block", "doc", "key").write.mode("overwrite").parquet(f"{out.path}/items")
        kind = dict(rows.dtypes)["key"]

        def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _small(batches, "words"):
                words = b.column("words")
                sizes = np.asarray(words.value_lengths())
                code = words.flatten().dictionary_encode()
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                ids = code.indices.to_numpy(zero_copy_only=False)
                order = np.lexsort((place, ids, row))
                r, c = row[order], ids[order]
                at = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])]) if len(r) else np.zeros(0, np.int64)
                ends = np.r_[at, len(r)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32)))
                who = pa.array(r[at])
                yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(c[at])), b.column("block").take(who), b.column("doc").take(who), b.column("key").take(who), pa.array(np.diff(ends), pa.int32()), lists], names=["term", "block", "doc", "key", "n", "positions"])

        words = rows.select("block", "doc", "key", terms(F.col("t")).alias("words"))
        found = words.mapInArrow(posted, f"term string, block int, doc bigint, key {kind}, n int, positions array<int>").withColumn("bucket", _bucket(F.col("term")))
        dealt = found.repartition("bucket", F.pmod(F.col("block"), F.lit(SALTS))).sortWithinPartitions("bucket", "term", "block", "doc")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{out.path}/postings")
        stored = spark.read.schema(_POSTINGS.format(kind=kind)).parquet(f"{out.path}/postings")
        best = stored.groupBy("bucket", "term", "block").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("items"))
        best.repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{out.path}/blocks")
        path_ = spark._jvm.org.apache.hadoop.fs.Path(f"{out.path}/source")
        path_.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path_, True)
        return out

    def _table(self, name: str, kind: str, words: list[str]) -> DataFrame:
        schema = _POSTINGS.format(kind=kind) if name == "postings" else _BLOCKS
        buckets = [r.b for r in self.spark.createDataFrame([(w,) for w in words] or [("",)], "w string").select(_bucket(F.col("w")).alias("b")).distinct().collect()]  # of the query's words
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("bucket").isin(buckets) & F.col("term").isin(words))

    def items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/items")

    def blocks(self, query: TextQuery) -> DataFrame:
        """(block, bound): the blocks that can hold a match, and the most that an item of each can score."""
        words = query.operands  # excluded ones too: where another alternative holds, they count for the rank
        rows = self._table("blocks", "string", words)
        most = {w: F.max(F.when(F.col("term") == w, F.col("most"))) for w in words}
        found = rows.groupBy("block").agg(*[c.alias(f"m{i}") for i, c in enumerate(most.values())])
        has = {w: F.col(f"m{i}").isNotNull() for i, w in enumerate(words)}
        able = accepts(TextQuery([(must, []) for must, _ in query.alternatives]), lambda unit: reduce(and_, [has[w] for w in unit]))
        counts = F.array(*[F.coalesce(F.col(f"m{i}"), F.lit(0)) for i in range(len(words))])
        return found.where(able).select("block", _bound(counts, query.near).alias("bound"))

    def _matches(self, postings: DataFrame, query: TextQuery) -> DataFrame:
        """(doc, key, rank) of the matching items of some postings."""
        every = query.operands
        rows = postings.groupBy("block", "doc", "key").agg(*[F.first(F.when(F.col("term") == w, F.col("positions")), True).alias(f"p{i}") for i, w in enumerate(every)])
        place = {w: F.col(f"p{i}") for i, w in enumerate(every)}

        def has(unit: list[str]) -> Column:
            moved = lambda w, k: F.transform(place[w], lambda x: x - k)
            starts = place[unit[0]]
            for k, w in enumerate(unit[1:], 1):
                starts = F.array_intersect(starts, moved(w, k))
            return F.coalesce(F.size(starts) > 0, F.lit(False))

        at = F.array(*[_counted(place[w]) for w in every])
        return with_rank(rows.where(accepts(query, has)), at, query.near).select("doc", "key", "rank")

    # --- many queries at once ---------------------------------------------------------------------------------------
    def search_all(self, queries: DataFrame, k: int = 30, key: str = "chunk_id", any_word: bool = False, first: int = FIRST) -> DataFrame:
        """(query, key, rank): for every row (query, text) of ``queries`` what :func:`search` gives for its text.

        Blocks are chosen for each query from the blocks' numbers, in two rounds as for one query. Queries with an alternative of
        excluded words alone look through the items in the order of their keys.
        """
        items = self.items()
        kind = dict(items.dtypes)["key"]
        asked = written(_parsed(queries, any_word), "queries")
        free = F.exists("alternatives", lambda a: F.size(a["must"]) == 0)  # of all items but some
        bound_, loose = asked.where(~free & (F.size("alternatives") > 0)), asked.where(free)
        spec = asked.select("query", "alternatives", "operands", "near")
        posted = self.spark.read.schema(_POSTINGS.format(kind=kind)).parquet(f"{self.path}/postings")
        numbers = self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks")

        # excluded words too: where another alternative holds, they count for the rank
        wanted = bound_.select("query", F.explode("operands").alias("term")).withColumn("bucket", _bucket(F.col("term")))
        most = wanted.join(numbers, ["bucket", "term"]).groupBy("query", "block").agg(F.map_from_entries(F.collect_list(F.struct("term", "most"))).alias("most"))
        most = most.join(spec, "query")
        able = F.exists("alternatives", lambda a: F.forall(a["must"], lambda u: F.forall(u, lambda w: F.map_contains_key(F.col("most"), w))))
        counts = F.transform("operands", lambda w: F.coalesce(F.try_element_at(F.col("most"), w), F.lit(0)))
        blocks = written(most.where(able).select("query", "block", _bound(counts, F.col("near")).alias("bound")), "blocks")

        terms_of = asked.select("query", F.explode("operands").alias("term")).withColumn("bucket", _bucket(F.col("term")))
        at = F.transform("operands", lambda w: _counted(F.try_element_at(F.col("at"), w)))

        def matches(rows: DataFrame) -> DataFrame:
            """(query, doc, key, rank) of postings with their queries."""
            found = rows.groupBy("query", "block", "doc", "key").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
            return with_rank(found.join(spec, "query").where(_accepted()), at, F.col("near")).select("query", "doc", "key", "rank")

        of_blocks = lambda chosen: matches(chosen.select("query", "block").join(terms_of, "query").join(posted, ["bucket", "term", "block"])).select("query", "key", "rank")
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
        placed = blocks.withColumn("_r", F.row_number().over(order))
        head = written(_best(of_blocks(placed.where(F.col("_r") <= first)), k), "head")
        least = head.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("least"))
        rest = placed.where(F.col("_r") > first).join(least, "query", "left").where(F.col("n").isNull() | (F.col("n") < k) | (F.col("bound") >= F.col("least")))
        out = _best(head.unionByName(of_blocks(rest)), k)

        if not loose.isEmpty():  # what holds any of their words is judged; all other items match, with rank 0
            held = loose.select("query").join(terms_of, "query").join(posted, ["bucket", "term"])
            some = written(held.select("query", "doc").distinct(), "held")
            most_held = some.groupBy("query").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
            lowest = items.orderBy("key", "doc").limit(k + most_held)  # at most as many of them hold a word
            others = lowest.withColumn("query", F.explode(F.array(*[F.lit(r["query"]) for r in loose.select("query").distinct().collect()])))
            others = others.join(some, ["query", "doc"], "left_anti").select("query", "key", F.lit(0.0).alias("rank"))
            out = out.unionByName(_best(matches(held).select("query", "key", "rank").unionByName(others), k))
        return out.select("query", F.col("key").alias(key), "rank")

    def search(self, text: str, k: int = 30, key: str = "chunk_id", any_word: bool = False, first: int = FIRST) -> DataFrame:
        """(key, rank) of the k best matches; ``any_word`` asks for one of the words instead of all."""
        query, items = TextQuery.parse(text), self.items()
        query = TextQuery.any_of(query.words) if any_word and query.words else query
        kind = dict(items.dtypes)["key"]
        schema = f"`{key}` {kind}, rank double"
        if not query.alternatives:
            return self.spark.createDataFrame([], schema)
        top = lambda df: df.orderBy(F.desc("rank"), "key").limit(k)
        postings = self._table("postings", kind, query.operands)
        if not all(must for must, _ in query.alternatives):  # all items but some: those without any of the words match, with rank 0
            others = items.join(postings.select("doc").distinct(), "doc", "left_anti").select("key", F.lit(0.0).alias("rank"))
            return top(self._matches(postings, query).select("key", "rank").unionByName(others)).select(F.col("key").alias(key), "rank")
        blocks = self.blocks(query)
        head = [r.block for r in blocks.orderBy(F.desc("bound"), "block").limit(first).collect()]
        best = top(self._matches(postings.where(F.col("block").isin(head)), query).select("key", "rank")).collect()  # k rows at most
        rest = blocks.where(~F.col("block").isin(head))
        if len(best) == k:
            rest = rest.where(F.col("bound") >= best[-1]["rank"])
        more = self._matches(postings.join(rest.select("block"), "block", "left_semi"), query)
        known = self.spark.createDataFrame(best, f"key {kind}, rank double")
        return top(known.unionByName(more.select("key", "rank"))).select(F.col("key").alias(key), "rank")


# --- parts of the search for many queries ----------------------------------------------------------------------------
_UNITS = pa.list_(pa.list_(pa.string()))
_ALTERNATIVE = pa.struct([("must", _UNITS), ("without", _UNITS)])


def _parsed(queries: DataFrame, any_word: bool) -> DataFrame:
    """(query, alternatives, operands, near) of (query, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [TextQuery.parse(t or "") for t in b.column("text").to_pylist()]
            found = [TextQuery.any_of(q.words) if any_word and q.words else q for q in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("query"), pa.array([[{"must": m, "without": w} for m, w in q.alternatives] for q in found], pa.list_(_ALTERNATIVE)), pa.array([q.operands for q in found], pa.list_(pa.string())), pa.array([q.near for q in found], pa.bool_())],
                names=["query", "alternatives", "operands", "near"],
            )

    kind = dict(queries.dtypes)["query"]
    return queries.select("query", "text").mapInArrow(run, f"query {kind}, alternatives array<struct<must:array<array<string>>,without:array<array<string>>>>, operands array<string>, near boolean")


def _has(unit: Column) -> Column:
    """Whether the postings ``at`` hold a word, or a phrase at consecutive positions."""
    starts = lambda w, k: F.transform(F.try_element_at(F.col("at"), w), lambda x: x - k)
    phrase = F.aggregate(F.sequence(F.lit(0), F.size(unit) - 1), F.try_element_at(F.col("at"), F.get(unit, F.lit(0))), lambda held, k: F.array_intersect(held, starts(F.get(unit, k), k)))
    return F.when(F.size(unit) == 1, F.map_contains_key(F.col("at"), F.get(unit, F.lit(0)))).otherwise(F.coalesce(F.size(phrase) > 0, F.lit(False)))


def _accepted() -> Column:
    return F.exists("alternatives", lambda a: F.forall(a["must"], _has) & ~F.exists(a["without"], _has))


def _counted(positions: Column) -> Column:
    """The places, from 1, that count for the rank; none for null."""
    return F.coalesce(counted(F.transform(positions, lambda i: i + 1)), F.array().cast("array<int>"))


def _bound(counts: Column, near: Column | bool) -> Column:
    """The most that an item can score whose words occur as often as ``counts`` tells, at most; rounded up."""
    near = F.lit(near) if isinstance(near, bool) else near
    n = F.transform(counts, lambda c: F.least(c, F.lit(PLACES)).cast("double"))
    total = F.aggregate(n, F.lit(0.0), lambda s, c: s + c)
    pairs = (total * total - F.aggregate(n, F.lit(0.0), lambda s, c: s + c * c)) / 2
    return F.when(near, 1 - F.pow(F.lit(1 - NEXT), pairs)).otherwise(by_count(F.transform(counts, lambda c: F.least(c, F.lit(PLACES))))) + 1e-6


def _best(rows: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query").orderBy(F.desc("rank"), "key")
    return rows.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k).drop("_r")
