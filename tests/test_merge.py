"""Tables with changes beside the base: reads equal a plain fold of all writes, before and after compaction."""

import os

import numpy as np
from pyspark.sql import functions as F

from millrace.sources.merge import MergeTable

SCHEMA = "session_id string, chunk_id string, content string, embedding array<double>, at bigint"


def state_of(table):
    return {(r.session_id, r.chunk_id): (r.content, r.embedding, r["at"]) for r in table.read().collect()}


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_reads_equal_a_fold_of_all_writes(spark, tmp_path):
    rng = np.random.default_rng(1)
    table = MergeTable(spark, str(tmp_path / "t"), SCHEMA, "chunk_id", "at")
    assert table.read().count() == 0 and table.compact() == 0
    base = [(f"s{k % 3}", f"c{k}", f"text {k}", None, 0) for k in range(60)]
    table.load(spark.createDataFrame(base, SCHEMA))
    want = {(s, c): {"content": (0, -1, t), "embedding": (0, -1, e), "at": a} for s, c, t, e, a in base}
    for n in range(6):
        name = f"{n:03}"
        if n == 3:  # whole rows, some of them new
            rows = [(f"s{k % 3}", f"c{k}", f"later {n}", [float(n)], int(rng.integers(0, 9))) for k in range(50, 66)]
            table.change(spark.createDataFrame(rows, SCHEMA), name)
            sets = [(s, c, {"content": t, "embedding": e}, v) for s, c, t, e, v in rows]
        else:
            rows = [(f"s{k % 3}", f"c{k}", [float(n), float(k)], int(rng.integers(0, 9))) for k in rng.choice(70, 12, replace=False).tolist()]
            table.change(spark.createDataFrame(rows, "session_id string, chunk_id string, embedding array<double>, at bigint"), name)
            sets = [(s, c, {"embedding": e}, v) for s, c, e, v in rows]
        for s, c, values, v in sets:
            row = want.setdefault((s, c), {"at": v})
            row["at"] = max(row["at"], v)
            for column, value in values.items():
                if column not in row or (v, n) >= row[column][:2]:
                    row[column] = (v, n, value)
    plain = {k: (r["content"][2], r["embedding"][2], r["at"]) for k, r in want.items() if "content" in r}
    assert state_of(table) == plain
    assert table.compact() == 6
    assert state_of(table) == plain and table.read().count() == len(plain) and table.compact() == 0


def test_a_small_update_rewrites_nothing(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path / "t"), SCHEMA, "chunk_id", "at")
    table.load(spark.range(2000).select(F.concat(F.lit("s"), F.col("id") % 2).alias("session_id"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("x").alias("content"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(0).cast("bigint").alias("at")))
    before = files(tmp_path / "t/base")
    some = table.read().where("session_id = 's1'").limit(20).select("session_id", "chunk_id", F.array(F.lit(1.0)).alias("embedding"), F.lit(5).cast("bigint").alias("at"))
    name = table.change(some, "one")
    assert files(tmp_path / "t/base") == before and table.change(some, name) == "one"
    assert table.read().where("embedding is not null").count() == 20 and table.read().count() == 2000
    table.compact()
    after = files(tmp_path / "t/base")
    assert {f for f in before if "s0" in f} <= set(after) and all(after[f] == before[f] for f in before if "s0" in f)
    assert table.read().where("embedding is not null").count() == 20


def test_last_writer_and_dropped_sessions(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path / "r"), "session_id string, content_md string, generated_at timestamp", "session_id", "generated_at")
    for name, md, at in (("b", "second", "2024-01-02"), ("a", "first", "2024-01-01"), ("c", "other", "2024-01-03")):
        table.change(spark.createDataFrame([("s2" if name == "c" else "s1", md)], "session_id string, content_md string").withColumn("generated_at", F.lit(at).cast("timestamp")), name)
    assert {r.session_id: r.content_md for r in table.read().collect()} == {"s1": "second", "s2": "other"}
    table.drop("s1")
    assert {r.session_id for r in table.read().collect()} == {"s2"}
    table.compact()
    table.drop("s2")
    assert table.read().count() == 0
