"""Log windows: runs of consecutive lines in the same time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import stable_id
from ..functions.timestamps import bucket, line_ts
from .ordered import with_block

KEYS = ["session_id", "document_id"]


def with_runs(lines: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Adds line_no, ts (of the line), at (forward filled; leading lines take the file's first), has_ts of the
    file, time_bucket, and line_start, the first line of the window that a line is in.

    ``lines`` has a line_no, or a seq that orders the lines and may have gaps, and perhaps a block, which cuts
    them in that order. A new window starts whenever the bucket differs from the line before, so lines out of
    order open another window with the same bucket. A file without any timestamp gets windows of
    ``fallback_lines`` lines in buckets that count up from the epoch.

    Each block is sorted once, for all that a line takes from the lines before it in the block. A second scan
    gives one narrow row per block; a window over those rows tells what is carried into each block.
    """
    order = "seq" if "seq" in lines.columns else "line_no"
    df = lines.withColumn("_block", F.col("block")) if "block" in lines.columns else with_block(lines, order, cfg.order_block)
    # dealt by block first, as the windows need it: a file that is read by one task is parsed by many. A stated number of
    # parts, as lines pack well and parsing costs more than their bytes tell
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(parts, *KEYS, "_block").withColumn("ts", line_ts(F.col("value"), cfg.syslog_year))
    of = lambda t: bucket(t, cfg.window_seconds)
    w = Window.partitionBy(*KEYS, "_block").orderBy(order)
    df = df.withColumn("_k", F.row_number().over(w)).withColumn("_filled", F.last("ts", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    changed = of(F.col("_filled")) != of(F.lag("_filled").over(w))  # null up to the block's first timestamp
    df = df.withColumn("_change", F.when(changed, F.col("_k")))
    df = df.withColumn("_turned", F.last("_change", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    timed = F.when(F.col("ts").isNotNull(), F.struct("_k", "ts"))
    ends = df.groupBy(*KEYS, "_block").agg(F.max("_k").alias("_n"), F.min(timed).alias("_first"), F.max(timed)["ts"].alias("_last"), F.max("_change").alias("_turn"))
    file = Window.partitionBy(*KEYS).orderBy("_block")
    before, whole = file.rowsBetween(Window.unboundedPreceding, -1), file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.coalesce(F.last("_last", ignorenulls=True).over(before), F.first("_first.ts", ignorenulls=True).over(whole)).alias("_in"))
    ends = ends.withColumn("_opens", F.when(of(F.col("_first.ts")) != of(F.col("_in")), F.col("_off") + F.col("_first._k")))
    last = F.greatest(F.col("_off") + F.col("_turn"), F.col("_opens"), F.when(F.col("_off") == 0, 1))
    carried = ends.withColumn("_own", last).select(*KEYS, "_block", "_off", "_in", "_opens", F.coalesce(F.last("_own", ignorenulls=True).over(before), F.lit(1)).alias("_start"))

    df = df.drop("line_no", "block").join(carried, [*KEYS, "_block"])
    line_no, has_ts, at = (F.col("_off") + F.col("_k")).cast("long"), F.col("_in").isNotNull(), F.coalesce("_filled", "_in")
    by_count = F.floor((line_no - 1) / cfg.fallback_lines)
    inside = F.coalesce(F.col("_off") + F.col("_turned"), F.when(F.col("_filled").isNotNull(), F.col("_opens")), F.col("_start"))
    kept = [c for c in lines.columns if c not in ("line_no", "block")]
    return df.select(
        *kept, line_no.alias("line_no"), "ts", at.alias("at"), has_ts.alias("has_ts"),
        F.when(has_ts, of(at)).otherwise(F.timestamp_seconds(by_count * cfg.window_seconds)).alias("time_bucket"),
        F.when(has_ts, inside).otherwise(by_count * cfg.fallback_lines + 1).cast("long").alias("line_start"),
    )


def chunks(runs: DataFrame) -> DataFrame:
    """(session_id, document_id, time_bucket, line_start, line_end, content, chunk_id) of each window."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    out = runs.groupBy(*KEYS, "time_bucket", "line_start").agg(F.max("line_no").alias("line_end"), F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias("content"))
    return with_chunk_id(out)


def with_chunk_id(windows: DataFrame) -> DataFrame:
    return windows.withColumn("chunk_id", stable_id(F.col("session_id"), F.col("document_id"), F.col("line_start")))


def boundaries(runs: DataFrame) -> DataFrame:
    """Lines at which a new window starts."""
    return runs.where("line_no = line_start")
