"""Keyed streaming state: completions that are claimed once, and progress feeds that close by themselves.

Both run on RocksDB state in the query's checkpoint. A batch that runs again after a failure starts from the state before it
and writes the same rows into the same folder (:func:`ingest.additive_sink`), so what a transition sets off happens once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import TERMINAL
from .ingest import run_available

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "true"}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State stores of queries started inside are on disk."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_stateful(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """:func:`ingest.run_available` on disk-backed state."""
    with rocksdb(stream.sparkSession):
        run_available(stream, checkpoint, sink)


# --- completions ------------------------------------------------------------------------------------------------
COUNTERS = "owner string, done bigint, total bigint, claimed boolean"


class Claim(StatefulProcessor):
    """Adds up an owner's counters; the batch that brings ``done`` up to a positive ``total`` claims the completion."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counters", "done bigint, total bigint, claimed boolean, gone boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        done, total, claimed, gone = self.state.get() if self.state.exists() else (0, 0, False, False)
        for r in rows:
            done, total, gone = done + r["done"], total + r["total"], gone or r["gone"]
        now = not claimed and not gone and total > 0 and done >= total
        self.state.update((done, total, claimed or now, gone))
        if not gone:
            yield Row(owner=key[0], done=done, total=total, claimed=now)

    def close(self) -> None:
        pass


def completions(events: DataFrame) -> DataFrame:
    """(owner, done, total, claimed) of each owner that a batch touches: counters so far; ``claimed`` is true exactly once.

    ``events`` is a stream (owner, item, done, total, gone): an item's marker counts ``done`` pieces of work, or adds
    ``total`` to what is expected, or says that the owner is ``gone``, after which its late work passes without a trace.
    An item that arrives again counts once, in whatever order all arrive. Repeated items are found by state keyed by owner
    and item, and each task adds up what is new before it goes to the owner's state: an owner of very many items costs
    its own task a row for each other task.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for b in batches:
            for owner, done, total, gone in zip(*(b.column(c).to_pylist() for c in ("owner", "done", "total", "gone")), strict=True):
                s = sums.setdefault(owner, [0, 0, False])
                s[0], s[1], s[2] = s[0] + (done or 0), s[1] + (total or 0), s[2] or bool(gone)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), *(pa.array([s[k] for s in sums.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_())))], names=["owner", "done", "total", "gone"])

    new = events.where("owner is not null").dropDuplicates(["owner", "item"]).select("owner", F.col("done").cast("bigint").alias("done"), F.col("total").cast("bigint").alias("total"), "gone")
    sums = new.mapInArrow(added, "owner string, done bigint, total bigint, gone boolean")
    return sums.groupBy("owner").transformWithState(Claim(), COUNTERS, "append", "none")


# --- progress feeds ---------------------------------------------------------------------------------------------
FEED = "key string, at_ms bigint, status string, enriched bigint, total bigint, closed boolean"


class Feed(StatefulProcessor):
    """One row for each sweep in which a key's state differs from what was last sent, or is terminal.

    The states of a sweep are held until the watermark passes its end; its latest one counts. A feed closes with a terminal
    state, or when its time is up, which a timer tells if nothing else arrives; what comes later is dropped.
    """

    def __init__(self, sweep_ms: int, cap_ms: int):
        self.sweep, self.cap = sweep_ms, cap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value a key: each call on the state costs as much as many rows
        self.handle = handle
        self.state = handle.getValueState("feed", "status string, enriched bigint, total bigint, opened bigint, closed boolean, held string")

    def _load(self) -> tuple[tuple, int | None, bool, dict[int, list]]:
        """(what was sent, end of the first sweep, closed, the latest [at_ms, seq, status, enriched, total] of each sweep held)."""
        if not self.state.exists():
            return (None, None, None), None, False, {}
        status, enriched, total, opened, closed, held = self.state.get()
        return (status, enriched, total), opened, closed, {k: v for k, *v in json.loads(held)}

    def _save(self, sent: tuple, opened: int | None, closed: bool, held: dict[int, list]) -> None:
        self.state.update((*sent, opened, closed, json.dumps([] if closed else [[k, *v] for k, v in held.items()])))

    def _end(self, sweep: int) -> int:
        return (sweep + 1) * self.sweep

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        sent, opened, closed, held = self._load()
        if closed:
            return
        first = min(held, default=None)
        for r in rows:
            at, seq, sweep = r["at_ms"], r["seq"], r["at_ms"] // self.sweep
            before = held.get(sweep)
            if before is None or (before[0], before[1]) < (at, seq):
                held[sweep] = [at, seq, r["status"], r["enriched"], r["total"]]
        if not held:
            return
        # a feed opens with its first sweep or, if an earlier one still arrives, before: what is over by this one stays over
        last = (self._end(min(held)) if opened is None else opened) + self.cap
        held = {k: v for k, v in held.items() if self._end(k) <= last}
        if held and (first is None or min(held) < first):
            self.handle.registerTimer(self._end(min(held)))
        self._save(sent, opened, closed, held)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All sweeps that are over, in their order; the next one that is held gets a timer."""
        sent, opened, closed, held = self._load()
        if closed:
            return
        now, new = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1), opened is None
        for sweep in sorted(k for k in held if self._end(k) <= now):
            at, _, *state = held.pop(sweep)
            if closed or (opened is not None and self._end(sweep) > opened + self.cap):  # over, whatever came in since
                continue
            opened = self._end(sweep) if opened is None else opened
            closed = state[0] in TERMINAL
            if closed or tuple(state) != sent:
                yield Row(key=key[0], at_ms=at, status=state[0], enriched=state[1], total=state[2], closed=closed)
            sent = tuple(state)
        if not closed and opened is not None and now > opened + self.cap:
            yield Row(key=key[0], at_ms=opened + self.cap, status=sent[0], enriched=sent[1], total=sent[2], closed=True)
            closed = True
        if not closed and new and opened is not None:
            self.handle.registerTimer(opened + self.cap + 1)
        if not closed and held:
            self.handle.registerTimer(self._end(min(held)))
        self._save(sent, opened, closed, held)

    def close(self) -> None:
        pass


def progress_feed(states: DataFrame, ts: str, late: str = "0 seconds", sweep_ms: int = 1500, cap_ms: int = 600_000) -> DataFrame:
    """(key, at_ms, status, enriched, total, closed): changes of the stream ``states`` (key, seq, status, enriched, total, ``ts``)."""
    rows = states.where(F.col(ts).isNotNull() & F.col("key").isNotNull()).withWatermark(ts, late)
    rows = rows.select("key", F.unix_millis(ts).alias("at_ms"), F.col("seq").cast("bigint").alias("seq"), "status", F.col("enriched").cast("bigint").alias("enriched"), F.col("total").cast("bigint").alias("total"), ts)
    return rows.groupBy("key").transformWithState(Feed(sweep_ms, cap_ms), FEED, "append", "EventTime")
