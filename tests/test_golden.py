"""Fixed small inputs with the results the engine is defined by."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.config import EngineConfig
from millrace.functions import text as T
from millrace.functions import timestamps as D
from millrace.operators import anomaly, findings, incidents, metrics, retrieval, segments, windows
from millrace.plans.ingest import ingest

UTC = dt.timezone.utc


def ts(*a):
    return dt.datetime(*a)


TIMES = [
    ("2024-01-01 00:00:07,179 INFO x", ts(2024, 1, 1, 0, 0, 7, 179000)),
    ("x [2024-01-01T00:00:00+05:30] y", ts(2023, 12, 31, 18, 30)),
    ("2024-01-01T00:00:00+0530", None),
    ("2024-02-30 00:00:00", None),
    ("2024-01-01 24:00:00Z", None),
    ("2024-01-01 23:59:60Z", None),
    ("Jan  1 00:00:00 host", ts(2026, 1, 1)),
    ("Jan 01 00:00:00 host", ts(2026, 1, 1)),
    ("Jan 12 00:00:00 host", ts(2026, 1, 12)),
    ("Jan 1 00:00:00", None),
    ("Jan   1 00:00:00", None),
    ("Feb 29 10:11:12", ts(2026, 2, 28, 10, 11, 12)),
    ("", None),
    (None, None),
]


def test_timestamps(spark):
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(TIMES)], "k int, v string")
    got = {r.k: r.t for r in df.select("k", D.line_ts(F.col("v"), 2026).alias("t")).collect()}
    assert [got[k] for k in range(len(TIMES))] == [t for _, t in TIMES]


def test_bucket_floors_before_1970(spark):
    r = spark.sql("select timestamp '1969-12-31 23:59:30' t").select(F.unix_seconds(D.bucket(F.col("t"), 60)).alias("s")).first()
    assert r.s == -60


def lines_df(spark, values, session="s"):
    return spark.createDataFrame([(session, "d", k + 1, v) for k, v in enumerate(values)], "session_id string, document_id string, line_no long, value string")


def run_table(spark, values, cfg=EngineConfig(order_block=3)):  # noqa: B008
    rows = windows.with_runs(lines_df(spark, values), cfg).groupBy("line_start").agg(F.max("line_no").alias("e"), F.first(F.unix_seconds("time_bucket")).alias("b")).orderBy("line_start").collect()
    return [(r.line_start, r.e, r.b) for r in rows]


def test_windows_are_runs(spark):
    a, b = "2024-01-01 00:00:01 x", "2024-01-01 00:01:01 x"
    base = 1704067200
    assert run_table(spark, ["lead", a, "  at trace", b, a]) == [(1, 3, base), (4, 4, base + 60), (5, 5, base)]


def test_fallback_windows(spark):
    got = run_table(spark, ["no time"] * 1201, EngineConfig(order_block=400))
    assert got == [(1, 500, 0), (501, 1000, 60), (1001, 1201, 120)]


def test_rules_and_traps(spark):
    t = "2024-01-01 00:00:01 "
    values = [t + "DELETE /x took=5ms status=302", t + "GC pause 12.5ms", t + "x_ERROR_y", t + "WARN a", t + "java.lang.FooException: x", t + "GET /feature/a status=200 latency: 7 ms"]
    done = ingest(lines_df(spark, values))
    got = {(r.category, r.metric): (r["count"], r.sum_ms, None if r.p95_ms is None else float(r.p95_ms)) for r in done.metrics.collect()}
    assert got[("API", "api_calls")][0] == 2 and got[("DATABASE", "sql_queries")][0] == 1
    assert got[("PERFORMANCE", "gc_pause_ms")] == (1, 13, 13.0)
    assert ("ERRORS", "errors") not in got and got[("ERRORS", "exception:FooException")][0] == 1
    assert got[("API", "api_latency_ms")] == (2, 12, 7.0) and got[("API", "ff_api_calls")][0] == 1
    assert got[("API", "api_2xx")][0] == 1 and ("API", "api_4xx") not in got and got[("TRAFFIC", "lines")][0] == 6


def test_metric_merge(spark):
    schema = "session_id string, time_bucket timestamp, category string, metric string, count long, sum_ms long, avg_ms decimal(12,2), p95_ms decimal(12,2), sample_chunk_ids array<string>, seq long"
    from decimal import Decimal as Dec

    t = ts(2024, 1, 1)
    ids = [f"a{k}" for k in range(19)]
    rows = [("s", t, "c", "n", 2, None, None, None, ids, 1), ("s", t, "c", "n", 3, None, None, None, ["b0", "b1", "b2"], 2), ("s", t, "c", "l", 2, 10, Dec(5), Dec(8), [], 1), ("s", t, "c", "l", 1, 100, Dec(100), Dec(100), [], 2), ("s", t, "c", "one", 1, None, None, None, [], 1)]
    got = {r.metric: r for r in metrics.merge_metrics(spark.createDataFrame(rows, schema)).collect()}
    assert (got["n"]["count"], got["n"].sum_ms, got["n"].avg_ms, got["n"].p95_ms) == (5, 0, Dec("0.00"), Dec("0.00"))
    assert got["n"].sample_chunk_ids == [*ids, "b0"]
    assert (got["l"]["count"], got["l"].sum_ms, got["l"].avg_ms, got["l"].p95_ms) == (3, 110, Dec("36.67"), Dec("100.00"))
    assert got["one"].sum_ms is None and got["one"].p95_ms is None


@pytest.mark.parametrize(("spike", "flagged"), [(31, 1), (30, 0)])
def test_outlier_is_strict(spark, spike, flagged):
    rows = [("s", ts(2024, 1, 1, 0, k), "A", "m", 10) for k in range(25)] + [("s", ts(2024, 1, 1, 1), "A", "m", spike)]
    df = spark.createDataFrame(rows, "session_id string, time_bucket timestamp, category string, metric string, p95_ms int")
    assert anomaly.outlier_buckets(df).count() == flagged


def test_findings_merge(spark):
    t = ts(2024, 1, 1)
    schema = "session_id string, category string, severity string, title string, explanation string, confidence double, evidence_chunk_ids array<string>, time_range_start timestamp, time_range_end timestamp, seq long"
    rows = [("s", "db", "WARN", "Deadlock on table 12", "first", 0.1, ["a", "b"], t, t, 1), ("s", "DB ", "ERROR", "deadlock  on table 7", "last", 0.2, ["b", "c"], t, t + dt.timedelta(1), 2)]
    (r,) = findings.merge(spark.createDataFrame(rows, schema)).collect()
    assert (r.occurrence_count, r.title, r.category, r.explanation, r.severity, r.evidence_chunk_ids) == (2, "Deadlock on table 12", "db", "last", "ERROR", ["a", "b", "c"])


def test_incident_gap_is_inclusive(spark):
    def islands(second, end=None):
        base = ts(2024, 1, 1)
        at = lambda s: None if s is None else base + dt.timedelta(seconds=s)
        rows = [("s", "c", 1, at(0), at(60)), ("s", "c", 2, at(second), at(second + 60)), ("s", "c", 3, None, None), ("s", "o", 4, at(30), at(60))]
        df = incidents.cluster(spark.createDataFrame(rows, "session_id string, category string, id long, time_range_start timestamp, time_range_end timestamp"))
        return {r.id: r.island for r in df.collect()}

    assert islands(360) == {1: 1, 2: 1, 3: -1, 4: 1} and islands(361) == {1: 1, 2: 2, 3: -1, 4: 1}


def test_rrf(spark):
    def ranked(keys, n):
        return spark.createDataFrame([(k, n, p) for p, k in enumerate(keys)], "key string, list_no int, position int")

    got = [(r.key, r.score) for r in retrieval.fuse([ranked("ab", 0), ranked("bc", 1)]).collect()]
    assert got == [("b", 0.03306), ("a", 0.016667), ("c", 0.016393)]


def test_json(spark):
    good = '{"category": "", "severity": "bad", "title": "t", "explanation": "e", "confidence": 2}'
    raws = [f"```json\n[{good}]\n```", good, "[]", "garbage", '[{"explanation": "e"}]', f"text [{good}] more", None]
    df = spark.createDataFrame(list(enumerate(raws)), "k int, raw string")
    got = [(r.k, r.category, r.severity, float(r.confidence)) for r in findings.parse(df).orderBy("k").collect()]
    assert got == [(k, "GENERAL", "WARN", 1.0) for k in (0, 1, 5)]


def test_splitter():
    assert segments.split_content("abc", 5) == ["abc"]
    assert [len(x) for x in segments.split_content("x" * 12000, 5000)] == [5000, 5000, 2000]
    records = "\n".join(f"2024-01-01 00:00:0{k} {'y' * 40}\n  more" for k in range(5))
    parts = segments.split_content(records, 150)
    assert all(len(p) <= 150 and p.startswith("2024") for p in parts)
    assert "\n".join(parts) == records


def test_text_query(spark):
    df = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick the fox"), (3, "brown dog")], "k int, t string")
    hit = lambda q: [r.k for r in df.where(retrieval.matches(T.terms(F.col("t")), retrieval.TextQuery.parse(q))).orderBy("k").collect()]
    assert hit("quick fox") == [1, 2] and hit('"the quick"') == [1] and hit("fox or dog") == [1, 2, 3] and hit("brown -fox") == [3] and hit("") == []


def test_no_line_matches_without_a_needed_word():
    """Random lines of the patterns' own words, in any case: wherever a pattern matches, one of its needed words is there."""
    from millrace.operators.metrics import FLAGS, NEEDS

    rng = np.random.default_rng(1)
    words = sorted({w for p in FLAGS.values() for w in re.findall(r"[A-Za-z]{2,}|\d{3}", p)} | {"ORA-12", "/a/b", "HTTP/1.1", "query:", "started x in 3", "status = DOWN", "connection  pool", "auth failure", "release 7"})
    joins, hits = [" ", "  ", "", "_", "-", "=", ": "], dict.fromkeys(FLAGS, 0)
    for _ in range(40_000):
        line = "".join(str(w) + str(j) for w, j in zip(rng.choice(words, 4), rng.choice(joins, 4)))
        line = line.upper() if rng.random() < 0.2 else line
        low = line.lower()
        for k, p in FLAGS.items():
            if re.search(p, line):
                hits[k] += 1
                assert any(w in low for w in NEEDS[k]), (k, line)
    assert sum(n > 0 for n in hits.values()) >= 20 and NEEDS.keys() == FLAGS.keys()
