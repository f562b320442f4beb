"""Interval join, clusters, rolling sums and percentiles: against plain loops, whatever the blocks, with hot keys."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.config import EngineConfig
from millrace.operators import budgets, incidents, metrics, segments, windows
from millrace.operators.intervals import interval_join
from millrace.operators.ordered import next_at_or_after
from millrace.operators.percentiles import exact_percentile

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=float(seconds))


@pytest.mark.parametrize("unit", [1, 60, 86_400])
def test_interval_join_against_plain_loops(spark, unit):
    rng = np.random.default_rng(1)
    ranges = [(f"s{rng.integers(0, 2)}", k, float(a), float(a + w)) for k, (a, w) in enumerate(zip(rng.integers(-5000, 5000, 60), rng.choice([0, 1, 59, 60, 61, 3600, 900_000], 60)))]
    ranges += [("s0", 100, 50.0, 20.0), ("s0", 101, None, 20.0), ("s0", 102, 0.0, None), (None, 103, 0.0, 9.0), ("s1", 104, 60.0, 60.0)]
    points = [(f"s{rng.integers(0, 2)}", k, float(x)) for k, x in enumerate(rng.integers(-6000, 6000, 200))] + [("s0", 900, None), (None, 901, 5.0), ("s1", 902, 60.0), ("s0", 903, 1.0), ("s0", 903, 1.0)]
    r = spark.createDataFrame([(s, k, at(a), at(b)) for s, k, a, b in ranges], "s string, r int, lo timestamp, hi timestamp").withColumn("a.b", F.lit(1))
    p = spark.createDataFrame([(s, k, at(x)) for s, k, x in points], "s string, p int, at timestamp").withColumn("x.y", F.lit(1))
    got = sorted((x.s, x.r, x.p) for x in interval_join(r, p, ["s"], "lo", "hi", "at", unit).collect())
    want = sorted((s, k, q) for s, k, a, b in ranges for t, q, x in points if s is not None and s == t and None not in (a, b, x) and a <= x <= b)
    assert got == want and len(got) > 100
    assert interval_join(r.limit(0), p, ["s"], "lo", "hi", "at").count() == 0 and interval_join(r, p.limit(0), ["s"], "lo", "hi", "at").count() == 0


def test_metric_context_meets_by_bins(spark):
    """One session: the pairs that meet are few times the pairs that belong together, and no join is on the session alone."""
    rows = spark.range(4000).select(F.lit("s").alias("session_id"), (F.lit(T0) + F.make_interval(mins=F.col("id").cast("int"))).alias("time_bucket"), F.lit("API").alias("category"), F.lit("n").alias("metric"), F.lit(1).alias("count"), F.lit(None).cast("decimal(12,2)").alias("avg_ms"), F.lit(None).cast("decimal(12,2)").alias("p95_ms"))
    ranges = spark.range(300).select(F.lit("s").alias("session_id"), F.col("id").alias("range_id"), (F.lit(T0) + F.make_interval(mins=(13 * F.col("id")).cast("int"))).alias("lo")).withColumn("hi", F.col("lo") + F.expr("interval 10 minutes"))
    found = metrics.metric_context(ranges, rows)
    assert found.count() == 300 * 11 - sum(max(0, 13 * k + 10 - 3999) for k in range(300))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "_bin" in join and "_level" in join


def plain_islands(rows, gap):
    """(session, category, key) to island by plain loops."""
    out, groups = {}, {}
    for s, c, a, b, k in rows:
        groups.setdefault((s, c), []).append((a, b, k))
    for (s, c), found in groups.items():
        island, latest, open_ = 0, None, False
        for a, b, k in sorted((x for x in found if x[0] is not None), key=lambda x: (x[0], x[2])):
            if latest is None or open_ or b is None or a > latest + gap:
                island += 1
            out[s, c, k] = island
            open_ = b is None
            latest = b if latest is None else latest if b is None else max(latest, b)
        for a, _, k in found:
            if a is None:
                out[s, c, k] = -1
    return out


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_clusters_do_not_depend_on_blocks(spark, size):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        a = None if rng.random() < 0.05 else float(rng.integers(0, 60) * 200)
        b = None if rng.random() < 0.1 else (a or 0) + float(rng.integers(0, 4) * 150)
        rows.append((("s1", "s1", "s1", "s2", None)[rng.integers(0, 5)], "c", a, b, k))
    df = spark.createDataFrame([(s, c, at(a), at(b), k) for s, c, a, b, k in rows], "session_id string, category string, time_range_start timestamp, time_range_end timestamp, id int").withColumn("note", F.lit("x"))
    cfg = EngineConfig()
    out = incidents.cluster(df, cfg, size=size)
    got = {(r.session_id, r.category, r.id): r.island for r in out.collect()}
    want = plain_islands(rows, cfg.cluster_gap_seconds)
    assert got == want and out.columns == [*df.columns, "island"] and max(want.values()) > 8
    assert incidents.cluster(df.limit(0), cfg).count() == 0


def test_no_window_over_a_whole_category(spark):
    """Windows over rows are by block; the others are over one row a block."""
    df = spark.range(2000).select(F.lit("s").alias("session_id"), F.lit("c").alias("category"), (F.lit(T0) + F.make_interval(secs=F.col("id"))).alias("time_range_start"), F.col("id"))
    df = df.withColumn("time_range_end", F.col("time_range_start"))
    out = incidents.cluster(df, size=50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert len(windows) == 2 and all("_block" in x for x in windows)
    assert out.agg(F.max("island")).first()[0] == 1


def test_rolling_sums_over_blocks(spark):
    """One key and one hot instant hold most rows; nulls are a key and an instant of their own."""
    rng = np.random.default_rng(4)
    rows = [("hot", float(x), int(n)) for x, n in zip(rng.integers(0, 3000, 800) / 2, rng.integers(0, 9, 800))] + [("hot", 960.0, 1)] * 300 + [("k", float(x), 2) for x in (0, 59.999999, 60, 960, 1019.999999, 1020, -1, -60)]
    rows += [(None, 5.0, 1), (None, 6.0, 1), ("k", None, 1), ("k", None, 1)]
    df = spark.createDataFrame([(k, at(x), n, i) for i, (k, x, n) in enumerate(rows)], "user string, ts timestamp, n long, i int")
    w = Window.partitionBy("user").orderBy(F.unix_micros("ts")).rangeBetween(-59_999_999, 0)
    want = {r.i: (r.c, r.t) for r in df.withColumn("c", F.count(F.lit(1)).over(w)).withColumn("t", F.sum("n").over(w)).collect()}
    for block in (1, 2, 16):
        out = budgets.rolling_budget(df, "user", "ts", F.col("n"), block=block)
        assert {r.i: (r.calls_in_window, r.tokens_in_window) for r in out.collect()} == want
        assert out.columns == [*df.columns, "calls_in_window", "tokens_in_window", "admitted"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("_block" in x for x in plan.splitlines() if "Window [" in x)


@pytest.mark.parametrize("bits", [2, 21])
@pytest.mark.parametrize("interpolate", [True, False])
def test_percentiles_by_histograms(spark, bits, interpolate):
    rng = np.random.default_rng(5)
    groups = {"many": rng.integers(-(2**30), 2**40, 700).tolist(), "ties": rng.integers(0, 4, 500).tolist(), "one": [7], "two": [1, 10], "neg": [-5, -9, -1, -1]}
    rows = [(g, int(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.p for r in exact_percentile(df, ["g"], F.col("v"), q, "p", interpolate, bits).collect()}
        for g, vs in groups.items():
            want = float(np.quantile(vs, q)) if interpolate else sorted(vs)[max(0, math.ceil(q * len(vs)) - 1)]
            assert got[g] == pytest.approx(want, rel=1e-12), (g, q)
        assert set(got) == set(groups)
    assert exact_percentile(df.limit(0), ["g"], F.col("v"), 0.5, "p").count() == 0


def plain_parts(units, cfg):
    """Parts of one file's units (first, last, bytes, opens, has_ts) by a plain fold."""
    out, first, used, last, hard = [], None, 0, 0, cfg.hard_part_factor * cfg.part_bytes
    for f, x, size, opens, has_ts in sorted(units):
        full = (used >= cfg.part_bytes and opens) or used >= hard if has_ts else first is not None and f - first >= cfg.part_lines
        if first is not None and full:
            out.append((first, last, used))
            first, used = None, 0
        first = f if first is None else first
        used, last = used + size, x
    return [*out, (first, last, used)]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_parts_by_pointers_equal_a_fold(spark, size):
    rng = np.random.default_rng(7)
    rows, start = [], dt.datetime(2024, 1, 1)
    for d in range(6):
        n = 0
        for w in range(int(rng.integers(1, 30))):
            for k in range(int(rng.integers(1, 9)) * (12 if w % 7 == 3 else 1)):
                n += 1
                head = f"{start + dt.timedelta(minutes=w)} " if d < 4 and (k == 0 or rng.random() < 0.4) else ""
                rows.append(("s" if d % 2 else None, f"d{d}", n, head + "x" * int(rng.integers(0, 40))))
    df = spark.createDataFrame(rows, "session_id string, document_id string, line_no long, value string").where("session_id is not null")
    for cfg in (EngineConfig(part_bytes=150, hard_part_factor=4, part_lines=9, fallback_lines=4), EngineConfig(part_bytes=1, hard_part_factor=1, part_lines=1, fallback_lines=1), EngineConfig()):
        runs = windows.with_runs(df, cfg).cache()
        files = {}
        for u in segments.part_units(runs, cfg).collect():
            files.setdefault(u.document_id, []).append((u.first, u.last, u.bytes, u.opens, u.has_ts))
        got = {}
        for r in segments.parts_plan(runs, cfg, size).orderBy("part_idx").collect():
            got.setdefault(r.document_id, []).append((r.first_line, r.last_line, r.bytes))
            assert r.part_idx == len(got[r.document_id]) - 1
        assert got == {d: plain_parts(u, cfg) for d, u in files.items()}
        runs.unpersist()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_parts_read_the_lines_once_and_no_frame_is_gone_through_row_by_row(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("s", "d", n, f"{start + dt.timedelta(minutes=n // 9)} x") for n in range(1, 300)], "session_id string, document_id string, line_no long, value string").write.parquet(str(tmp_path / "lines"))
    cfg = EngineConfig(part_bytes=150, hard_part_factor=1)
    units = segments.part_units(windows.with_runs(spark.read.parquet(str(tmp_path / "lines")), cfg), cfg)
    assert not any(str(tmp_path) in f for f in units.inputFiles())
    rows = units.select("session_id", "document_id", F.col("first").alias("at"), F.col("first").alias("pos"))
    found = next_at_or_after(rows, rows, ["session_id", "document_id"], "at", "pos", "pos", "next", 7)
    assert "unboundedfollowing" not in plan_of(found)
    assert {(r["at"], r["next"]) for r in found.collect()} == {(r["at"], r["at"]) for r in rows.collect()}


def test_titles_come_row_by_row_and_the_findings_are_read_once(spark, tmp_path):
    rows = [("s", "c", k, at(600 * (k // 9)), at(600 * (k // 9) + 5), f"t{k}") for k in range(60)] + [("s", "c", 99, None, None, "t99")]
    spark.createDataFrame(rows, "session_id string, category string, id long, time_range_start timestamp, time_range_end timestamp, title string").write.parquet(str(tmp_path / "f"))
    found = incidents.cluster(spark.read.parquet(str(tmp_path / "f")), size=7)
    assert not any(str(tmp_path / "f") in f for f in found.inputFiles())
    named = incidents.cluster_titles(found, found.where("id % 2 = 0"))
    assert "collect" not in plan_of(named)
    want = incidents.titles(incidents.incidents(found), found.where("id % 2 = 0"))
    assert sorted(map(tuple, named.select("incident", "finding_id", "title").collect())) == sorted(map(tuple, want.collect()))
    assert {(r["finding_id"], r["title"]) for r in named.collect()} == {(r[2], r[5] if r[2] % 2 == 0 else str(r[2])) for r in rows}
