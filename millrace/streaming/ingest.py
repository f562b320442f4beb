"""Streaming ingest: windows of arriving lines, merged into keyed tables with exactly-once effect."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import error_category, truncated


def tumbling_counts(events: DataFrame, ts: str, keys: list[str], width: str = "60 seconds", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts by event-time window. Without ``late`` every late row still lands in its window."""
    if late:
        events = events.withWatermark(ts, late)
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(win.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("bucket"), *keys, "n", "total")


def session_counts(events: DataFrame, ts: str, keys: list[str], gap: str = "5 minutes") -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def additive_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of partial rows in a folder of the batch's own: a batch that runs again overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process all that has arrived, then stop; the checkpoint carries on where it ended."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def with_dead_letters(work: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int, str], None], attempts: int = 3, pause: float = 2.0) -> Callable[[DataFrame, int], None]:
    """Tries a batch several times, ``pause`` seconds apart, then hands it to ``dead`` with the error's start instead of failing the stream."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for k in range(attempts):
            try:
                return work(batch, batch_id)
            except Exception as e:
                if k == attempts - 1:
                    dead(batch, batch_id, str(e)[:1000])
                else:
                    time.sleep(pause)

    return run


def mark_failed(documents: DataFrame, failures: DataFrame, size: int = 1000) -> DataFrame:
    """``documents`` with processing_status FAILED and error_message where ``failures`` (document_id, part_idx, error) names them:
    the first failed part's, or the whole document's (part_idx null). Completed documents stay as they are."""
    text = F.concat(F.when(F.col("part_idx").isNull(), "Ingest").otherwise(F.concat(F.lit("Part "), F.col("part_idx"))), F.lit(" failed: "), F.col("error"))
    first = failures.groupBy("document_id").agg(F.min_by(truncated(text, size), F.struct(F.coalesce("part_idx", F.lit(-1)), "error")).alias("_message"))
    bad = F.col("_message").isNotNull() & (F.col("processing_status") != "COMPLETED")
    out = documents.join(first, "document_id", "left").withColumn("error_message", F.when(bad, F.col("_message")))
    return out.withColumn("processing_status", F.when(bad, "FAILED").otherwise(F.col("processing_status"))).drop("_message")


def route(items: DataFrame, error: Column, now_ms: Column, delay_seconds: int = 60, max_attempts: int = 1440) -> DataFrame:
    """Adds route (DONE, RETRY, DLQ), next_attempt and not_before_epoch_ms from each item's outcome.

    Only rate limits are retried, until the attempts are used up.
    """
    limited = error_category(error) == "RATE_LIMIT"
    again = limited & (F.col("attempt") + 1 < max_attempts)
    out = items.withColumn("route", F.when(error.isNull(), "DONE").when(again, "RETRY").otherwise("DLQ"))
    out = out.withColumn("next_attempt", F.when(F.col("route") == "RETRY", F.col("attempt") + 1).otherwise(F.col("attempt")))
    return out.withColumn("not_before_epoch_ms", F.when(F.col("route") == "RETRY", now_ms + delay_seconds * 1000).otherwise(F.lit(0)).cast("bigint"))


def ready(items: DataFrame, now_ms: int) -> DataFrame:
    return items.where(F.col("not_before_epoch_ms") <= now_ms)


def progress_changes(states: DataFrame, key: str, order: str) -> DataFrame:
    """States that differ from the one before, and every terminal one."""
    from pyspark.sql import Window

    from ..schemas import TERMINAL

    mark = F.concat_ws(":", "status", "enriched", "total")
    w = Window.partitionBy(key).orderBy(order)
    df = states.withColumn("_m", mark).withColumn("_p", F.lag("_m").over(w))
    return df.where(F.col("_p").isNull() | (F.col("_p") != F.col("_m")) | F.col("status").isin(*TERMINAL)).drop("_m", "_p")


def finished(documents: DataFrame, markers: DataFrame) -> DataFrame:
    """Documents all of whose parts have a marker and that are not completed yet; redelivered markers count once."""
    n = markers.select("document_id", "part_idx").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("parsed"))
    return documents.join(n, "document_id").where((F.col("parsed") >= F.col("total_parts")) & (F.col("processing_status") == "PROCESSING"))
