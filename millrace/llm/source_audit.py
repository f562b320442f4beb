r"""Divergence of sources: every source of a language against every other, and the terms that mark a source.

Term counts of each (language, source) group become vectors over the language's kept vocabulary. The vocabulary is
cut into chunks and the groups into blocks; each chunk's counts of a group are one packed row. A task of the tiling
gets two blocks of groups, to which the packed rows are replicated, and computes its part of the pair matrix over
successive chunks, one chunk's rows in memory at a time. Long vocabularies are dealt over several tasks per tile,
a stripe of chunks each, and added up.

With N the sum of a group's counts over kept terms and V the vocabulary's size, a term's weight is
``1 + floor(SCALE * (count + 1) / (N + V))``, and the value of p against q ``floor((p - q)^2 / q)``; all integers.
Weights are at most SCALE + 1, so a square fits in 64 bits, and so does a sum while V is below two thousand million.
Terms that no group of a tile holds in a chunk add the same value each and are counted, not visited.

Texts are cut and counted in Arrow batches, so the shuffle carries one row for each group, term and task. No step
gathers a group: vectors are gathered by chunk, whose terms are some CHUNK; best terms are picked in each task first.

Defined results: null text, language and source are ''; a group whose documents have no term is compared all the
same; a language without kept terms has value 0 for each pair; repeated rows count as often as they occur; an empty
table gives an empty one. Only the three named columns are read, further columns of any name are not. A very long
text is cut in its task, and only its distinct terms go on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import combined, written

SCALE = 1_000_000_000
#: Documents of a language that must hold a term; ranks of the term report.
MIN_DOCS, TOP_TERMS = 3, 200
#: Terms of a chunk on average, groups of a block, chunks of a stripe.
CHUNK, BLOCK, STRIPE = 2048, 4, 32
#: Distinct (group, term) pairs that a task holds before it passes them on, and cells of the matrices of one step.
HELD, CELLS = 500_000, 1 << 18
#: ASCII letters in lower case; other bytes below 128 separate terms.
_TABLE = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_COUNTED = "lang string, source string, term string, n bigint, df bigint"


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences, and documents with it, of each term in each group; a null term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                k = len(n) + 1
                terms = pa.concat_arrays([pa.array(list(n), pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())])
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, k), pa.repeat(source, k), terms, pa.array([*n.values(), 0], pa.int64()), pa.array([*map(df.__getitem__, n), 0], pa.int64())],
                    names=["lang", "source", "term", "n", "df"],
                )
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                words = text.as_buffer().to_pybytes().translate(_TABLE).split()
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(words)
                df.update(set(words))
                size += len(n)
                if size > HELD:
                    yield from passed()
                    size = 0
        yield from passed()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # tasks have added up what they hold, so rows are dealt by term at once: another partial aggregate would find little
    dealt = rows.mapInArrow(combined(run), _COUNTED).repartition("lang", "source", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def weight(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + size)), exactly."""
    wide = "decimal(38,0)"
    top = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")).cast(wide)
    low = (total + size).cast("decimal(20,0)").cast(wide)
    return (F.call_function("div", top, low) + 1).cast("bigint")


def value(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exactly."""
    return F.call_function("div", (p - q) * (p - q), q)


def _deal(key: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def _tile(rows: list[tuple], of_block: tuple[int, int]) -> Iterator[tuple[str, str, int]]:
    """(source, item, part of the value) for each ordered pair of the two blocks over one chunk."""
    width, names = rows[0][2], [r[1] for r in rows]
    blocks = np.array([r[0] for r in rows])
    floor = np.array([r[3] for r in rows], np.int64)
    ids = [np.asarray(r[4]) for r in rows]
    some = np.unique(np.concatenate(ids)) if ids else np.zeros(0, np.int32)
    rest = width - len(some)
    left, right = (np.flatnonzero(blocks == b) for b in of_block)
    sums = np.zeros((len(rows), len(rows)), np.int64)
    for lo in range(0, max(len(some), 1), max(CELLS // len(rows), 1)):
        part = some[lo : lo + max(CELLS // len(rows), 1)]
        p = np.repeat(floor[:, None], len(part), 1)
        for k, at in enumerate(ids):
            a, b = np.searchsorted(at, part[0]) if len(part) else 0, np.searchsorted(at, part[-1], "right") if len(part) else 0
            p[k, np.searchsorted(part, at[a:b])] = np.asarray(rows[k][5])[a:b]
        for one, other in ((left, right), (right, left)) if of_block[0] != of_block[1] else ((left, right),):
            for k in one:
                d = p[k] - p[other]
                sums[k, other] += (d * d // p[other]).sum(1)
    for one, other in ((left, right), (right, left)) if of_block[0] != of_block[1] else ((left, right),):
        for k in one:
            d = floor[k] - floor[other]
            for h, base in zip(other, d * d // floor[other]):
                if k != h:
                    yield names[k], names[h], int(sums[k, h]) + rest * int(base)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by tile, chunk and source; one chunk of one tile in memory at a time. Sums leave with the tile."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            tile = zip(*(batch.column(c).to_pylist() for c in ("lang", "stripe", "one", "other", "chunk", "block", "source", "width", "floor")))
            yield from ((*x, batch.column("ids")[k].values, batch.column("ps")[k].values) for k, x in enumerate(tile))

    for (lang, _, one, other), tile in groupby(rows(), key=lambda r: r[:4]):
        sums: Counter = Counter()
        for _, chunk in groupby(tile, key=lambda r: r[4]):
            for source, item, v in _tile([(r[5], r[6], r[7], r[8], r[9], r[10]) for r in chunk], (one, other)):
                sums[source, item] += v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums)), pa.array([s for s, _ in sums]), pa.array([i for _, i in sums]), pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "item", "value"])


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(place).alias("rank"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, chunk: int = CHUNK, block: int = BLOCK, stripe: int = STRIPE) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for each other source of the language, ``term`` rows for a group's marked terms."""
    counts = written(count_terms(docs), "term-counts")
    terms = counts.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("c")).where(F.col("df") >= min_docs)
    kept = written(kept.select("lang", "term", "c"), "vocabulary")
    langs = counts.where("term is null").select("lang", "source").groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("all"))
    langs = langs.join(sizes, "lang", "left").fillna(0, ["v", "all"]).withColumn("n_chunks", F.ceil(F.col("v") / chunk).cast("int")).withColumn("n_blocks", F.ceil(F.col("n_groups") / block).cast("int"))
    langs = written(langs, "languages")

    # numbers of terms in their chunk
    place = Window.partitionBy("lang", "chunk").orderBy("term")
    numbered = kept.join(langs.select("lang", "n_chunks"), "lang").withColumn("chunk", _deal(F.col("term"), F.col("n_chunks"))).withColumn("id", F.row_number().over(place) - 1)
    cells = terms.select("lang", "source", "term", "n").join(numbered.select("lang", "term", "c", "chunk", "id"), ["lang", "term"])
    cells = written(cells, "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang")
    groups = written(groups, "groups")

    weighed = cells.join(groups.select("lang", "source", "total", "v", "all"), ["lang", "source"])
    weighed = weighed.withColumn("p", weight(F.col("n"), F.col("total"), F.col("v")))
    marked = weighed.withColumn("q", weight(F.col("c"), F.col("all"), F.col("v"))).where("n > 0 and p > q")
    marked = marked.select("lang", "source", F.col("term").alias("item"), value(F.col("p"), F.col("q")).alias("value"))

    packed = weighed.groupBy("lang", "chunk", "source").agg(F.sort_array(F.collect_list(F.struct("id", "p"))).alias("x"))
    packed = packed.select("lang", "chunk", "source", F.col("x")["id"].alias("ids"), F.col("x")["p"].alias("ps"))
    widths = numbered.groupBy("lang", "chunk").agg(F.count(F.lit(1)).cast("int").alias("width"))
    base = groups.where("n_chunks > 0").withColumn("floor", weight(F.lit(0), F.col("total"), F.col("v"))).withColumn("block", _deal(F.col("source"), F.col("n_blocks")))
    base = base.select("lang", "source", "block", "n_blocks", "floor", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
    vectors = base.join(widths, ["lang", "chunk"]).join(packed, ["lang", "chunk", "source"], "left")
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>")).alias(c)
    met = vectors.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    met = met.select("lang", F.floor(F.col("chunk") / stripe).cast("int").alias("stripe"), F.least("block", "met").alias("one"), F.greatest("block", "met").alias("other"), "chunk", "block", "source", "width", "floor", empty("ids", "int"), empty("ps", "bigint"))
    tiled = met.repartition("lang", "stripe", "one", "other").sortWithinPartitions("lang", "stripe", "one", "other", "chunk", "source")
    pairs = tiled.mapInArrow(_tiles, "lang string, source string, item string, value bigint").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("n_chunks = 0").select("lang", "source")
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    # a bounded rank is looked for in each task first, so a group's shuffled rows are top_terms for each task at most
    return _ranked(pairs.unionByName(bare), "pair").unionByName(_ranked(marked, "term").where(F.col("rank") <= top_terms))


#: All sums in wide integers.
ORACLE = rf"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as txt from documents),
t as (
    select rid, lang, source, unnest(regexp_extract_all(translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from d
),
g as (select distinct lang, source from d),
k as (select lang, term, count(*) as c from t group by lang, term having count(distinct rid) >= {MIN_DOCS}),
s as (select lang, count(*)::hugeint as v, sum(c)::hugeint as a from k group by lang),
n as (select lang, source, term, count(*) as n from t join k using (lang, term) group by lang, source, term),
o as (select lang, source, sum(n)::hugeint as total from n group by lang, source),
w as (
    select g.lang, g.source, k.term, coalesce(n.n, 0) as n, 1 + ({SCALE}::hugeint * (coalesce(n.n, 0) + 1)) // (coalesce(o.total, 0) + s.v) as p,
        1 + ({SCALE}::hugeint * (k.c + 1)) // (s.a + s.v) as q
    from g join s using (lang) join k using (lang) left join n on n.lang = g.lang and n.source = g.source and n.term = k.term
        left join o on o.lang = g.lang and o.source = g.source
),
pairs as (
    select a.lang, a.source, b.source as item, coalesce((
        select sum(((x.p - y.p) * (x.p - y.p)) // y.p) from w x join w y using (lang, term) where x.lang = a.lang and x.source = a.source and y.source = b.source
    ), 0) as value
    from g a join g b on a.lang = b.lang and a.source <> b.source
),
terms as (select lang, source, term as item, ((p - q) * (p - q)) // q as value from w where n > 0 and p > q),
every as (
    select lang, source, 'pair' as part, item, value from pairs
    union all select lang, source, 'term', item, value from terms
),
r as (select lang, source, part, item, value::bigint as value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from every)
select * from r where part = 'pair' or rank <= {TOP_TERMS}"""
