"""Completions and progress feeds over restarts, redelivery and reordering, against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.schemas import TERMINAL
from millrace.streaming import ingest, state

T0 = dt.datetime(2024, 1, 1)
EVENTS = "owner string, item string, done long, total long, gone boolean"
STATES = "key string, seq long, status string, enriched long, total long, ts timestamp"


def feed_in(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_a_completion_is_claimed_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    src, out, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    events = []
    for d in range(12):
        n = int(rng.integers(1, 9))
        events += [(f"d{d}", f"total{k}", 0, part, False) for k, part in enumerate((n - n // 2, n // 2)) if part]
        events += [(f"d{d}", f"part{k}", 1, 0, False) for k in range(n - (d == 3))]  # d3 never gets its last part
    events += [("d5", "deleted", 0, 0, True), (None, "x", 1, 1, False), ("none", "a", 1, 0, False)]
    events += [e for e in events if rng.random() < 0.5]  # redelivered
    order = rng.permutation(len(events))
    parts = np.array_split(order, 5)

    def go():
        state.run_stateful(state.completions(source(spark, src, EVENTS)), ck, ingest.additive_sink(out))
        return spark.read.parquet(out)

    for k, part in enumerate(parts):  # a restart after each arrival
        feed_in(spark, src, f"p{k}", [events[i] for i in part], EVENTS)
        rows = go()
    won = [r.owner for r in rows.where("claimed").collect()]
    assert sorted(won) == sorted(set(won)) and set(won) >= {f"d{d}" for d in range(12) if d not in (3, 5)} and "d3" not in won
    last = {r.owner: (r.done, r.total) for r in rows.groupBy("owner").agg(F.max("done").alias("done"), F.max("total").alias("total")).collect()}
    for d in range(12):
        mine = {e[1]: e for e in events if e[0] == f"d{d}"}
        if d != 5:
            assert last[f"d{d}"] == (sum(e[2] for e in mine.values()), sum(e[3] for e in mine.values()))
    assert last["none"] == (1, 0)
    before = rows.count()
    feed_in(spark, src, "late", [*events[:20], ("d5", "partx", 1, 0, False)], EVENTS)  # all known, and late work of a deleted owner
    assert go().where("claimed").count() == len(won) and go().count() == before


def plain_feed(rows, sweep, cap):
    out, by = [], {}
    for key, seq, status, enriched, total, at in rows:
        if key is not None and at is not None:
            by.setdefault(key, {}).setdefault(at // sweep, []).append((at, seq, status, enriched, total))
    for key, sweeps in by.items():
        sent, opened = None, None
        for s in sorted(sweeps):
            at, _, *new = max(sweeps[s])
            end = (s + 1) * sweep
            if opened is None:
                opened = end
            if end > opened + cap:
                break
            over = new[0] in TERMINAL
            if over or new != sent:
                out.append((key, at, *new, over))
            sent = new
            if over:
                break
        else:
            s = None
        if not (sent and sent[0] in TERMINAL):
            out.append((key, opened + cap, *sent, True))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4])
def test_feed_equals_plain_loops(spark, tmp_path, batches):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(900):
        status = ("PENDING", "ENRICHING", "ENRICHING", "CORRELATING", "DONE", "FAILED")[rng.choice(6, p=[0.3, 0.3, 0.2, 0.18, 0.01, 0.01])]
        rows.append((f"k{rng.integers(0, 8)}", k, status, int(rng.integers(0, 3)), 3, int(k * 250 + rng.integers(0, 400))))
    rows += [("quiet", 1, "PENDING", 0, 1, 100), (None, 1, "DONE", 0, 1, 100), ("k0", 2000, "PENDING", None, None, 90_000)]
    rows.sort(key=lambda r: r[5])
    src, out, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    make = lambda r: (*r[:5], T0 + dt.timedelta(milliseconds=r[5]))
    run = lambda: state.run_stateful(state.progress_feed(source(spark, src, STATES), "ts", "2 seconds", 1500, 60_000), ck, ingest.additive_sink(out))
    for b, part in enumerate(np.array_split(np.arange(len(rows)), batches)):
        chosen = [make(rows[i]) for i in part]
        feed_in(spark, src, f"b{b}", [chosen[i] for i in rng.permutation(len(chosen))], STATES)
        run()
    feed_in(spark, src, "end", [("end", 0, "DONE", 0, 0, T0 + dt.timedelta(days=30))], STATES)
    run()
    zero = spark.createDataFrame([(T0,)], "t timestamp").select(F.unix_millis("t").alias("ms")).first().ms
    assert zero % 1500 == 0
    got = sorted((r.key, r.at_ms - zero, r.status, r.enriched, r.total, r.closed) for r in spark.read.parquet(out).where("key <> 'end'").collect())
    want = plain_feed(rows, 1500, 60_000)
    assert list(map(str, got)) == list(map(str, want)) and sum(r[5] for r in want) == len({r[0] for r in rows if r[0]})


def test_a_feed_calls_its_state_once_a_batch():
    """However many sweeps a batch brings: one value is read and written, and one timer set; what is over by the first sweep is not held."""

    class Value:
        def __init__(self):
            self.value, self.calls = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value, self.calls = value, self.calls + 1

    class Handle:
        def __init__(self):
            self.value, self.timers = Value(), []

        def getValueState(self, *_):
            return self.value

        def registerTimer(self, at):
            self.timers.append(at)

    class Time:
        def __init__(self, at):
            self.getExpiryTimeInMs, self.getCurrentWatermarkInMs = lambda: at, lambda: at + 1

    feed, handle = state.Feed(10, 100), Handle()
    feed.init(handle)
    rows = [{"at_ms": t, "seq": t, "status": f"S{t // 40}", "enriched": 0, "total": 0} for t in range(5, 500, 5)]
    assert list(feed.handleInputRows(("k",), iter(rows), None)) == [] and handle.value.calls == 1 and handle.timers == [10]
    out = list(feed.handleExpiredTimer(("k",), Time(60), Time(60)))
    assert [(r.at_ms, r.status, r.closed) for r in out] == [(5, "S0", False), (45, "S1", False)] and handle.timers == [10, 111, 70]
    out = list(feed.handleExpiredTimer(("k",), Time(300), Time(300)))
    assert [(r.at_ms, r.status, r.closed) for r in out] == [(85, "S2", False), (110, "S2", True)] and handle.timers == [10, 111, 70]
    assert list(feed.handleInputRows(("k",), iter(rows), None)) == [] and handle.value.calls == 3
