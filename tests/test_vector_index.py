"""The stored vector index: recall and the share of pairs compared, odd rows, adding, hot cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval
from millrace.operators.vector_index import VectorIndex

SF = "/root/testdata/sf0.01"


def recall_of(found, exact):
    want = {}
    for r in exact:
        want.setdefault(r["query"], set()).add(r["vec_id"])
    got = {(r["query"], r["key"]) for r in found}
    return sum((q, k) in got for q, ks in want.items() for k in ks) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_pairs_compared(spark, tmp_path, sf):
    items = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    queries = items.where("vec_id % 20 = 0")
    index = VectorIndex.build(items, str(tmp_path / "index"), "vec_id")
    exact = retrieval.knn_all(items, queries, 10, "vec_id").collect()
    assert recall_of(index.search(queries, 10, "vec_id").collect(), exact) >= 0.9
    compared = index.candidates(queries, 40, "vec_id").count()
    assert compared <= 0.1 * items.count() * queries.count()


def clustered(n, seed=1, clusters=30, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, width)) * 3
    return centres[rng.integers(0, clusters, n)] + 0.3 * rng.standard_normal((n, width))


def test_clusters_are_searched_by_cell(spark, tmp_path):
    """With clusters few cells are looked into, so few codes are read at all."""
    x = clustered(6000)
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = VectorIndex.build(items, str(tmp_path / "index"), "vec_id")
    assert index.model.probes <= 0.2 * len(index.model.centres)
    queries = items.where("vec_id % 20 = 0")
    exact = retrieval.knn_all(items, queries, 10, "vec_id").collect()
    found = index.search(queries, 10, "vec_id").collect()
    assert recall_of(found, exact) >= 0.9 and len(found) == 10 * 300
    sims = {(r["query"], r["vec_id"]): r["similarity"] for r in exact}
    assert all(sims.get((r["query"], r["key"]), r["similarity"]) == pytest.approx(r["similarity"], abs=2e-6) for r in found)


def test_added_items_are_found(spark, tmp_path):
    x = clustered(3000, 2)
    rows = [(f"k{k:05}", v.tolist()) for k, v in enumerate(x)]
    items = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    index = VectorIndex.build(items.where("chunk_id < 'k02000'"), str(tmp_path / "index"))
    index.add(items.where("chunk_id >= 'k02000'"))
    queries = items.where("chunk_id like '%50'")
    found = VectorIndex(spark, str(tmp_path / "index")).search(queries, 10).collect()
    exact = [{"query": r["query"], "vec_id": r["chunk_id"]} for r in retrieval.knn_all(items, queries, 10).collect()]
    assert recall_of(found, exact) >= 0.9 and max(r["key"] for r in found) >= "k02000"


def test_odd_rows(spark, tmp_path):
    x = clustered(400, 3, width=7).tolist()
    odd = [(1000, None), (1001, []), (1002, [1.0, 2.0]), (1003, [float("nan")] * 7), (1004, [0.0] * 7), (1005, [None] + x[0][1:]), (1006, [float("inf")] + x[0][1:])]
    items = spark.createDataFrame([*enumerate(x), *odd, (5, x[5])], "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("k", F.lit(2)).withColumn("a.b", F.lit(3))
    index = VectorIndex.build(items, str(tmp_path / "index"), "vec_id")
    found = index.search(items.where("vec_id = 5 or vec_id >= 1000"), 4, "vec_id").collect()
    assert {r["query"] for r in found} == {5, 1004}
    assert sorted((r["key"], r["similarity"]) for r in found if r["query"] == 5)[:1] == [(5, 1.0)] and sum(r["query"] == 5 for r in found) == 4
    assert all(r["similarity"] == 0 for r in found if r["query"] == 1004)
    none = VectorIndex.build(items.limit(0), str(tmp_path / "none"), "vec_id")
    assert none.search(items, 4, "vec_id").count() == 0


def test_one_cell_of_copies(spark, tmp_path):
    """A third of all rows is one vector: its blocks are shared out, ties go by key."""
    x = clustered(900, 4)
    rows = [(k, (x[k] if k % 3 else x[0]).tolist()) for k in range(900)] + [(900 + k, x[0].tolist()) for k in range(6000)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex.build(items, str(tmp_path / "index"), "vec_id")
    found = index.search(items.where("vec_id = 0"), 5, "vec_id").orderBy("key").collect()
    assert [r["key"] for r in found] == [0, 3, 6, 9, 12] and all(r["similarity"] == 1 for r in found)
    blocks = spark.read.parquet(str(tmp_path / "index/codes"))
    assert blocks.agg(F.sum(F.size("keys"))).first()[0] == len(rows) and blocks.agg(F.max(F.size("keys"))).first()[0] <= 2048


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_exact_search_holds_a_share_and_streams_the_queries(spark):
    """Blocks are not copied to each other by a join: a batch of such pairs holds as many matrices as it has rows."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(3 + k % 2).tolist()) for k in range(500)] + [(900, None), (901, [])]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = retrieval.knn_all(items, items.where("vec_id % 20 < 2 or vec_id >= 900"), 7, "vec_id")
    assert "join" not in plan_of(near)
    got = {}
    for r in near.collect():
        got.setdefault(r["query"], []).append((-r["similarity"], r["vec_id"]))
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v}
    for q in (k for k in unit if k % 20 < 2):
        want = sorted((-round(float(unit[q] @ x), 6), k) for k, x in unit.items() if len(x) == len(unit[q]))[:7]
        assert [k for _, k in sorted(got.pop(q))] == [k for _, k in want]
    assert not got


def test_a_query_goes_once_to_a_share(spark, tmp_path):
    """However many cells and blocks it meets there: not once for each cell and copy."""
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(clustered(3000, 6))], "vec_id long, embedding array<double>")
    index = VectorIndex.build(items, str(tmp_path / "index"), "vec_id")
    found = index.candidates(items.where("vec_id % 20 = 0"), 40, "vec_id")
    assert "join" not in plan_of(found) and found.groupBy("query").count().where("count <> 40").isEmpty()
    at, share = index.model.shares(np.arange(len(index.model.centres)))
    stored = {(r["cell"], r["share"]) for r in spark.read.parquet(str(tmp_path / "index/codes")).select("cell", "share").distinct().collect()}
    assert stored <= set(zip(at.tolist(), share.tolist()))
