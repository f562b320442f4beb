"""Plans: what is read and shuffled, and results that SQL twins don't cover."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import catalogue
from millrace.config import EngineConfig
from millrace.operators import segments, windows
from millrace.plans import analyse
from millrace.plans import ingest as plans
from millrace.sources.lines import read_lines, split_lines, synth_log_lines
from millrace.streaming import ingest as streams

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def counted(df):
    """Scans of the source, shuffles and sorts of a plan before adaptive execution."""
    scans, full = plan_of(df)
    return len(re.findall(r"FileScan", scans)), len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", full)), len(re.findall(r"\bSort \[", full))


def test_windows_flagged_reads_its_source_twice(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = synth_log_lines(spark.read.parquet(f"{SF}/events.parquet"))
        scans, shuffles, sorts = counted(plans.summary(lines, catalogue.CFG))
        assert scans <= 2 and shuffles <= 5 and sorts <= 6
        seen, write = [], plans.written
        monkeypatch.setattr(plans, "written", lambda df, name: seen.append(name) or write(df, name))
        flagged = catalogue.windows_flagged(spark, SF)
        assert seen == ["windows"]  # the summary is written once; nothing after it reads the events
        assert "events.parquet" not in str(flagged._jdf.queryExecution().optimizedPlan().toString())
        assert all("events.parquet" not in f for f in flagged.inputFiles())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_runs_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(1)
    t0 = dt.datetime(2024, 1, 1)
    values = [f"{t0 + dt.timedelta(seconds=int(s))} x" if rng.random() < 0.5 else "  more" for s in np.cumsum(rng.integers(-20, 40, 400))]
    df = spark.createDataFrame([("s", f"d{k % 2}", k // 2 + 1, v) for k, v in enumerate(values)] + [("s", "none", k, "x") for k in range(1, 30)], "session_id string, document_id string, line_no long, value string")
    cols = ["document_id", "line_no", "at", "has_ts", "time_bucket", "line_start"]
    got = [sorted(map(str, windows.with_runs(df, EngineConfig(order_block=b, fallback_lines=12)).select(*cols).collect())) for b in (1, 3, 7, 1000)]
    assert got[0] == got[1] == got[2] == got[3]


def test_lines_of_files(spark, tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_bytes(b"one\r\ntwo\rthree\n\nb\xffd\n" + "é".encode() + b" last")
    b.write_bytes(b"".join(b"line %d %s\n" % (k, b"x" * (k % 90)) for k in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = {(r.document_id[-5:], r.line_no): r.value for r in read_lines(spark, str(tmp_path), "s").collect()}
        assert split_lines(spark, str(tmp_path), "s").select("document_id", "block").distinct().count() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [got["a.log", k] for k in range(1, 7)] == ["one", "two", "three", "", "b\ufffdd", "é last"]
    assert all(got["b.log", k + 1] == f"line {k} " + "x" * (k % 90) for k in range(20_000)) and len(got) == 20_006


def test_parts_are_cut_hard_on_records(spark):
    t = "2024-01-01 00:00:01 "
    values = [t + "x" * 30 if k % 3 == 0 else "  y" * 10 for k in range(60)]  # one window of 60 lines, 20 records
    df = spark.createDataFrame([("s", "d", k + 1, v) for k, v in enumerate(values)], "session_id string, document_id string, line_no long, value string")
    cfg = EngineConfig(part_bytes=100, hard_part_factor=4)
    parts = segments.parts_plan(windows.with_runs(df, cfg), cfg).orderBy("part_idx").collect()
    sizes = [sum(len(values[k - 1]) + 1 for k in range(p.first_line, p.last_line + 1)) for p in parts]
    assert [p.bytes for p in parts] == sizes and sizes[:-1] == [s for s in sizes[:-1] if 400 <= s < 540] and len(parts) > 3
    assert all((p.first_line - 1) % 3 == 0 for p in parts) and [p.first_line for p in parts[1:]] == [p.last_line + 1 for p in parts[:-1]]


def test_late_and_unordered_rows(spark, tmp_path):
    """Without a watermark a late row still counts; with one it is dropped once its window is closed."""
    t0, src = dt.datetime(2024, 1, 1), tmp_path / "in"
    batches = [[0, 30, 70], [65, 400], [10, 410], [9000], [20]]
    for k, b in enumerate(batches):
        rows = [(t0 + dt.timedelta(seconds=s), "k", 1.0) for s in b]
        spark.createDataFrame(rows, "at timestamp, k string, value double").coalesce(1).write.mode("append").parquet(str(src / f"{k}"))

    def run(late, name):
        stream = spark.readStream.schema("at timestamp, k string, value double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src / "*"))
        out = str(tmp_path / name)
        streams.run_available(streams.tumbling_counts(stream, "at", ["k"], late=late), str(tmp_path / f"{name}-ck"), streams.additive_sink(out), "update")
        rows = spark.read.parquet(out).groupBy("bucket").agg(F.max_by("n", "batch").alias("n")).collect()
        return {int((r.bucket - t0).total_seconds()): r.n for r in rows}

    assert run(None, "all") == {0: 4, 60: 2, 360: 1, 400 // 60 * 60 + 60 - 60: 1, 9000: 1} | {360: 2}
    assert run("1 minute", "late")[0] < 4


def test_reports_hold_every_incident(spark):
    class Model:
        seen = []

        def complete(self, system, user):
            Model.seen.append(user)
            return user

    t0 = dt.datetime(2024, 1, 1)
    inc = spark.createDataFrame([("s", f"i{k:03}", t0 + dt.timedelta(hours=k) if k else None, f"n{k:03}") for k in range(70)], "session_id string, id string, time_range_start timestamp, narrative string")
    found = spark.createDataFrame([("s", 1)], "session_id string, x int")
    rows = spark.createDataFrame([], "session_id string, category string, metric string, count long, p95_ms decimal(12,2), avg_ms decimal(12,2)")
    r = analyse.report(spark, "s", rows, found, inc, Model(), EngineConfig(report_rows=8)).first()
    assert '"incident_count": 70' in r.content_json and r.generated_at is not None
    body = re.findall(r"n\d{3}", r.content_md)
    assert body == [f"n{k:03}" for k in [*range(1, 70), 0]]
