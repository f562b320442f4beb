"""Redelivery, budgets, routing and the engine from files to answers."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from millrace.config import EngineConfig
from millrace.engine import Engine
from millrace.operators import budgets
from millrace.operators.text_index import TextIndex
from millrace.plans import analyse
from millrace.ports import EchoModel, HashEmbedder
from millrace.sources import tables
from millrace.streaming import ingest as streams

T0 = dt.datetime(2024, 1, 1)


def test_redelivered_part_is_skipped(spark):
    parts = spark.createDataFrame([("d", 0), ("d", 1), ("d", 1)], "document_id string, part_idx int")
    done = spark.createDataFrame([("d", 0)], "document_id string, part_idx int")
    assert [(r.document_id, r.part_idx) for r in tables.unprocessed(parts, done).collect()] == [("d", 1)]


def test_rolling_window_blocks(spark):
    calls = spark.createDataFrame([("k", T0 + dt.timedelta(milliseconds=10 * n)) for n in range(76)] + [("k", T0 + dt.timedelta(seconds=120))], "key string, ts timestamp")
    out = budgets.rolling_budget(calls, "key", "ts", F.lit(1)).orderBy("ts").collect()
    assert [r.admitted for r in out] == [True] * 75 + [False, True]


def test_token_bucket(spark):
    calls = spark.createDataFrame([("k", T0)] * 16 + [("k", T0 + dt.timedelta(seconds=4))], "key string, ts timestamp")
    out = budgets.token_bucket(calls, "key", "ts").orderBy("at").collect()
    assert sum(r.granted for r in out[:16]) == 15 and out[16].granted


def test_key_health(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("k", at(s), ok) for s, ok in ((0, False), (1, False), (2, False), (3, True), (400, True))]
    out = budgets.key_health(spark.createDataFrame(rows, "key string, ts timestamp, ok boolean"), "key", "ts", F.col("ok")).orderBy("at").collect()
    assert [r.enabled for r in out] == [True, True, True, False, True]


def test_router(spark):
    rows = [(1, 0, None), (2, 0, "429"), (3, 1439, "429"), (4, 0, "boom")]
    out = streams.route(spark.createDataFrame(rows, "k int, attempt int, error string"), F.col("error"), F.lit(1000)).orderBy("k").collect()
    assert [(r.route, r.next_attempt, r.not_before_epoch_ms) for r in out] == [("DONE", 0, 0), ("RETRY", 1, 61000), ("DLQ", 1439, 0), ("DLQ", 0, 0)]


def test_dead_letters():
    seen = []

    def work(batch, k):
        seen.append(k)
        raise ValueError("no")

    streams.with_dead_letters(work, lambda b, k, e: seen.append(e), pause=0.01)(None, 7)
    assert seen == [7, 7, 7, "no"]


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    spark.range(50).selectExpr("id % 5 k", "id value").coalesce(1).write.parquet(str(src / "a"))
    schema = "k long, value long"

    def go():
        s = spark.readStream.schema(schema).parquet(str(src / "*")).groupBy("k").agg(F.sum("value").alias("v"))
        streams.run_available(s, str(tmp_path / "ck"), streams.additive_sink(str(out)), "update")
        rows = spark.read.parquet(str(out)).groupBy("k").agg(F.max_by("v", "batch").alias("v")).orderBy("k").collect()
        return [(r.k, r.v) for r in rows]

    first = go()
    assert first == [(k, sum(range(k, 50, 5))) for k in range(5)]
    assert go() == first
    spark.range(50, 60).selectExpr("id % 5 k", "id value").coalesce(1).write.parquet(str(src / "b"))
    assert go() == [(k, sum(range(k, 60, 5))) for k in range(5)]


def test_engine_end_to_end(spark, tmp_path):
    log = tmp_path / "app.log"
    lines = [f"2024-01-01 00:{m:02d}:00 INFO GET /a status=200 took={10 if m != 25 else 900}ms" for m in range(30)]
    lines[7] += "\n2024-01-01 00:07:01 ERROR java.lang.BoomException: deadlock"
    log.write_text("\n".join(lines) + "\n")
    e = Engine(spark, str(tmp_path / "tables"), EngineConfig())
    e.ingest(str(log), "s1")
    once = sorted(map(str, e.chunks().drop("created_at").collect()))
    e.ingest(str(log), "s1")
    assert sorted(map(str, e.chunks().drop("created_at").collect())) == once and len(once) == 30
    assert {r.time_bucket.minute for r in e.chunks().where("is_anomalous").collect()} == {7, 25}
    e.analyse("s1")
    assert e.findings("s1").count() >= 1 and e.incidents("s1").count() >= 1
    assert "Key Metrics" in e.report("s1").first().content_md
    a = e.drilldown("s1", "BoomException deadlock")
    assert a.citations and e.history("s1").count() == 1
    # vectors change without the session being rewritten, the last report counts, and compaction changes nothing
    ids = [r.chunk_id for r in e.chunks().orderBy("chunk_id").limit(2).collect()]
    e.store_embeddings(spark.createDataFrame([("s1", ids, [[1.0, 2.0], None, [3.0]])], "session_id string, chunk_ids array<string>, vectors array<array<float>>"), 1)
    assert {r.chunk_id: r.embedding for r in e.chunks().where(F.col("chunk_id").isin(ids)).collect()} == dict(zip(ids, ([1.0, 2.0], None), strict=True))
    assert e.backfill("s1", 2) == 1 and e.backfill("s1", 3) == 0
    before, report = sorted(map(str, e.chunks().collect())), e.report("s1").first()
    e.analyse("s1")
    assert e.report("s1").count() == 1 and e.report("s1").first().generated_at > report.generated_at
    e.compact()
    assert sorted(map(str, e.chunks().collect())) == before and e.report("s1").count() == 1
    e.drop("s1")
    assert e.chunks().count() == 0 and e.report("s1").count() == 0


def test_many_questions_as_one_by_one(spark, tmp_path):
    """One run over all questions gives what single runs give: found at once, after a rewrite, by any word, or not at all."""
    rng = np.random.default_rng(6)
    words = [f"word{k}" for k in range(60)]
    rows = [("s", f"c{k:03}", " ".join(rng.choice(words, 12)), HashEmbedder().embed([f"c{k}"])[0]) for k in range(120)]
    chunks = spark.createDataFrame(rows, "session_id string, chunk_id string, content string, embedding array<float>")
    index = TextIndex.build(chunks, str(tmp_path / "index"), block_items=16)

    class Picky(EchoModel):
        """Finds evidence useful only where the question holds no x; rewrites x away."""

        def complete(self, system, user):
            if system.startswith("grade") and " x" in user.splitlines()[0]:
                return '{"useful": []}'
            return user.replace(" x", "", 1) if system == "rewrite" else super().complete(system, user)

    class Blank(HashEmbedder):
        """Without a vector for half of all questions."""

        def embed(self, texts):
            return [v if len(t) % 2 else [] for t, v in zip(texts, super().embed(texts), strict=True)]

    asked = [f"{a} {b}" for a, b in zip(rng.choice(words, 12), rng.choice(words, 12))] + ["word1 nosuch", "nothing at all", "word2 x", "word3 word4 x x", "word5 x x x x", '"word1 word2" or word7', "-word3", ""]
    questions = spark.createDataFrame([(f"q{k:02}", q) for k, q in enumerate(asked)], "question_id string, question string")
    cfg = EngineConfig(retrieve_limit=6)
    got = {r.question_id: (r.answer, r.citations) for r in analyse.drilldown_each(chunks, questions, Picky(), Blank(), index, cfg).collect()}
    assert len(got) == len(asked)
    for k, q in enumerate(asked):
        one = analyse.drilldown(chunks, q, Picky(), Blank(), cfg, index)
        assert got[f"q{k:02}"] == (one.text, one.citations), q
    assert sum(a == analyse.NO_EVIDENCE for a, _ in got.values()) >= 1 and sum(bool(c) for _, c in got.values()) > 12
