"""The positional index against the search that reads the texts."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval
from millrace.operators.text_index import TextIndex, _small

WORDS = "the on quick brown fox jumps over lazy dog Under_score x1 and".split()
QUERIES = [
    "the on", "fox or dog", "brown -fox", "nosuchword", '"quick brown"', '"quick brown fox" or "lazy dog"', 'the -"on the"', "-fox", '-"the on" -dog', '"the the the"', "the or nosuchword fox", "",
    "or", "-", "fox or", "or fox", "fox or or dog", "the or -fox", '"fox"', "FOX under_score", '"x1 and" -x1', "the the", '-"nosuch phrase"', "dog -nosuchword", '"brown nosuchword"',
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(3)
    p = np.array([30, 9, 5, 5, 4, 3, 3, 2, 2, 2, 1, 1.0])
    rows = [(k, " ".join(rng.choice(WORDS, int(rng.integers(0, 40)), p=p / p.sum()))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "!! ..."), (1003, "The  QUICK-brown fox."), (3, "fox the on"), (1004, "the " * 50_000)]
    return spark.createDataFrame(rows, "chunk_id int, content string").withColumn("term", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("a.b", F.lit(3))


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    return TextIndex.build(texts, str(tmp_path_factory.mktemp("index") / "i"), block_items=9)


def answers(df):
    return [(r["chunk_id"], r["rank"]) for r in df.collect()]


@pytest.mark.parametrize(("query", "any_word"), [*((q, False) for q in QUERIES), *((q, True) for q in QUERIES[:4])])
def test_index_equals_reading_the_texts(texts, index, query, any_word):
    for k, first in ((7, 2), (1000, 32)) if query in QUERIES[:6] and not any_word else ((7, 2),):
        assert answers(index.search(query, k, any_word=any_word, first=first)) == answers(retrieval.full_text(texts, query, k, any_word=any_word))


def plain_rank(words, query):
    """Rank by plain loops: by the distances between the places of different words, or by how often they occur."""
    at = {w: list(dict.fromkeys(min(i + 1, 16383) for i, x in enumerate(words) if x == w))[:256] for w in query.operands}
    if not query.near:
        return round(sum(sum(1 / j**2 for j in range(1, len(p) + 1)) for p in at.values()) * (0.1 / 1.64493406685) / max(len(at), 1), 6)
    left = 1.0
    for i, a in enumerate(query.operands):
        for b in query.operands[:i]:
            for x in at[a]:
                for y in at[b]:
                    d = abs(x - y)
                    if d:
                        left *= 1 - 0.1 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * np.exp(d / 1.5 - 2))) ** 0.5
    return round(1 - left, 6)


def plain_match(words, text):
    """The query read from left to right: sides of a free ``or`` are alternatives."""
    query = retrieval.TextQuery.parse(text)
    joined = f" {' '.join(words)} "
    return query, any(all(f" {' '.join(u)} " in joined for u in must) and not any(f" {' '.join(u)} " in joined for u in without) for must, without in query.alternatives)


@pytest.mark.parametrize("text", QUERIES)
def test_ranks_by_plain_loops(texts, text):
    rows = texts.where("chunk_id <= 60 or chunk_id >= 1000").where("chunk_id <> 1004").select("chunk_id", "content").collect()
    got = answers(retrieval.full_text(texts.where("chunk_id <= 60 or chunk_id >= 1000").where("chunk_id <> 1004"), text, 1000))
    want = []
    for r in rows:
        words = re.findall("[a-z0-9_]+", (r.content or "").lower())
        query, hit = plain_match(words, text)
        if r.content is not None and hit:
            want.append((r.chunk_id, plain_rank(words, query)))
    assert sorted(k for k, _ in got) == sorted(k for k, _ in want)
    assert sorted(v for _, v in got) == pytest.approx(sorted(v for _, v in want), abs=2e-6)


def test_or_binds_least():
    parse = lambda t: retrieval.TextQuery.parse(t).alternatives
    assert parse("a b or c -d") == [([["a"], ["b"]], []), ([["c"]], [["d"]])]
    assert parse("or a or") == [([["or"], ["a"], ["or"]], [])] and parse('"a b" or "c"') == [([["a", "b"]], []), ([["c"]], [])]
    assert parse("a or or b") == [([["a"]], []), ([["or"], ["b"]], [])] and parse("- or") == [([["or"]], [])] and parse("") == []


def test_blocks_are_skipped(spark, tmp_path):
    """A few items with many occurrences: blocks that cannot reach the best are not read."""
    rows = [(k, "common word here" if k % 50 else "common common common common word word word") for k in range(2000)]
    df = spark.createDataFrame(rows, "chunk_id int, content string")
    index = TextIndex.build(df, str(tmp_path / "i"), block_items=20)
    query = retrieval.TextQuery.parse("common word")
    bounds = sorted((r.bound for r in index.blocks(query).collect()), reverse=True)
    best = answers(index.search("common word", 5, first=8))
    assert best == answers(retrieval.full_text(df, "common word", 5))
    assert len(bounds) > 60 and sum(b >= best[-1][1] for b in bounds) < 0.6 * len(bounds)
    assert index.blocks(retrieval.TextQuery.parse("common nosuchword")).count() == 0


def test_no_text_is_read_by_retrieval_with_an_index(spark, texts, index):
    found = retrieval.retrieve(texts, "quick -dog", None, 10, index=index)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in retrieval.retrieve(texts, "quick -dog", None, 10).collect()]
    plan = index.search("quick -dog", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "postings" in str(index.search("quick -dog", 10).inputFiles())
    either = retrieval.retrieve(texts, "nosuchword fox", None, 10, index=index).collect()
    assert [tuple(r) for r in either] == [tuple(r) for r in retrieval.retrieve(texts, "nosuchword fox", None, 10).collect()] and len(either) == 10


@pytest.mark.parametrize("any_word", [False, True])
def test_many_queries_equal_single_ones(spark, texts, index, any_word):
    queries = spark.createDataFrame([(f"q{n:02}", q) for n, q in enumerate([*QUERIES, None])], "query string, text string")
    for k, first in ((7, 2), (1000, 32)):
        got = {}
        for r in index.search_all(queries, k, any_word=any_word, first=first).collect():
            got.setdefault(r["query"], []).append((r["chunk_id"], r["rank"]))
        for n, q in enumerate(QUERIES):
            assert sorted(got.get(f"q{n:02}", []), key=lambda x: (-x[1], x[0])) == answers(retrieval.full_text(texts, q, k, any_word=any_word)), q
        assert f"q{len(QUERIES):02}" not in got


def test_empty_items(spark, texts, tmp_path):
    none = TextIndex.build(texts.limit(0), str(tmp_path / "none"))
    assert none.search("the").count() == 0 and none.search("-the").count() == 0
    odd = TextIndex.build(texts.where("chunk_id in (1000, 1001)"), str(tmp_path / "odd"))
    assert odd.search("the").count() == 0 and answers(odd.search("-the")) == [(1001, 0.0)]


def test_excluded_words_count_in_the_bound_of_a_block(spark, tmp_path):
    """Where another alternative holds, or an excluded phrase does not, an excluded word counts for the rank: blocks are not passed over."""
    rows = [(k, "on the x1" + " the" * (k % 5) + (" licensed" * 30 + " the on the" if k > 150 else "")) for k in range(200)]
    texts = spark.createDataFrame(rows, "chunk_id int, content string")
    index = TextIndex.build(texts, str(tmp_path / "i"), block_items=4)
    for query in ('"on the" or x1 -licensed', '"on the" x1 -"licensed x1"'):
        want = answers(retrieval.full_text(texts, query, 5))
        assert want[0][0] > 150 and answers(index.search(query, 5, first=1)) == want
        asked = spark.createDataFrame([(1, query)], "query int, text string")
        assert [(r["chunk_id"], r["rank"]) for r in index.search_all(asked, 5, first=1).orderBy(F.desc("rank"), "chunk_id").collect()] == want


def test_batches_are_cut_by_the_words_they_hold():
    """A batch of long texts is worked off in parts, whatever its rows; each row stays whole."""
    words = pa.array([["a"] * n for n in (3, 4, 9, 0, 1, 1)])
    batch = pa.RecordBatch.from_arrays([words, pa.array(range(6))], names=["words", "k"])
    parts = list(_small(iter([batch]), "words", 8))
    assert [p.column("k").to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5]]
    assert sum((p.column("words").to_pylist() for p in parts), []) == words.to_pylist()
