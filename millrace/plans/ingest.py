"""The ingest plan: lines to one summary per window, written once, and metric rows and anomaly flags from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import anomaly, metrics, windows
from ..operators.metrics import WINDOW, MetricRule
from ..sources.scratch import written


@dataclass(frozen=True)
class Ingested:
    #: One row per window; with its text (content) if that was asked for.
    table: DataFrame
    metrics: DataFrame
    windows: DataFrame


def summary(lines: DataFrame, cfg: EngineConfig = EngineConfig(), extra: tuple[MetricRule, ...] = (), content: bool = False) -> DataFrame:  # noqa: B008
    """The one pass over the lines: two scans of the source, of which one is narrow, and one aggregate."""
    return metrics.window_table(metrics.features(windows.with_runs(lines, cfg)), extra=extra, content=content)


def ingest(lines: DataFrame, cfg: EngineConfig = EngineConfig(), extra: tuple[MetricRule, ...] = (), content: bool = False) -> Ingested:  # noqa: B008
    """Everything that a session's lines give; ``extra`` rules join the built-in ones in the same aggregate.

    The summary is written once; metrics, flags and whatever follows read its few rows per window.
    """
    rows = written(summary(lines, cfg, extra, content), "windows")
    table = rows.where("exception_class is null").drop("exception_class", "rows")
    metric_rows = metrics.long_metrics(table, extra=extra).unionByName(metrics.exception_metrics(rows))
    local = windows.with_chunk_id(anomaly.local_anomaly(table, cfg))
    return Ingested(table, metric_rows, anomaly.flag_latency_outliers(local, metric_rows, cfg))


def session_metrics(rows: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """Metric rows of all windows merged per bucket, each with its window's chunk id as a sample."""
    sampled = windows.with_chunk_id(rows).select("session_id", "time_bucket", "category", "metric", "count", "sum_ms", "avg_ms", "p95_ms", F.array("chunk_id").alias("sample_chunk_ids"), F.col("line_start").alias("seq"))
    return metrics.merge_metrics(sampled, cfg)


def wide(done: Ingested) -> DataFrame:
    """Windows with their flag and a few exact counts, for reading."""
    n = lambda c: F.col(f"`{c}.n`").alias(c.split(".")[1])
    counts = done.table.select(*WINDOW, n("TRAFFIC.lines"), n("API.api_calls"), n("ERRORS.errors"), F.col("`API.api_latency_ms.p95`").cast("bigint").alias("api_p95_ms"))
    return done.windows.join(counts, WINDOW)
