"""Anomalous windows: what a window shows by itself, and latency outliers against the session's corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import stable_id
from .metrics import WINDOW
from .ordered import number_lines
from .percentiles import exact_percentile


def local_anomaly(table: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """Windows with is_anomalous: an error, exception, deadlock, … on any line, or many WARN lines."""
    return table.select(*WINDOW, "line_end", (F.col("intrinsic") | (F.col("warn_lines") >= cfg.warn_threshold)).alias("is_anomalous"))


def corpus_p95(metrics: DataFrame) -> DataFrame:
    """Interpolated 95th percentile of the windows' p95, per session, category and metric."""
    return _p95(metrics, True)


def _p95(metrics: DataFrame, interpolate: bool) -> DataFrame:
    """Percentiles over hundredths: p95_ms has two decimals."""
    found = exact_percentile(metrics, ["session_id", "category", "metric"], F.col("p95_ms").cast("decimal(20,2)") * 100, 0.95, "_hundredths", interpolate)
    return found.select("session_id", "category", "metric", (F.col("_hundredths") / 100).alias("corpus_p95"))


def outlier_buckets(metrics: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    corpus = corpus_p95(metrics)
    far = metrics.join(corpus, ["session_id", "category", "metric"]).where((F.col("corpus_p95") > 0) & (F.col("p95_ms").cast("double") > cfg.latency_multiplier * F.col("corpus_p95")))
    return far.select("session_id", "time_bucket").distinct()


def flag_latency_outliers(windows: DataFrame, metrics: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """``windows`` with is_anomalous raised in outlier buckets, and newly_flagged; a flag is never lowered."""
    buckets = outlier_buckets(metrics, cfg).withColumn("_out", F.lit(True))
    out = windows.join(buckets, ["session_id", "time_bucket"], "left").withColumn("_out", F.coalesce("_out", F.lit(False)))
    return out.withColumn("newly_flagged", F.col("_out") & ~F.col("is_anomalous")).withColumn("is_anomalous", F.col("is_anomalous") | F.col("_out")).drop("_out")


def in_memory_anomaly(table: DataFrame, metrics: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """All rules at once, per window, against the nearest-rank percentile of the corpus."""
    corpus = _p95(metrics, False)
    far = metrics.join(corpus, ["session_id", "category", "metric"]).where((F.col("corpus_p95") > 0) & (F.col("p95_ms").cast("double") > cfg.latency_multiplier * F.col("corpus_p95"))).select(*WINDOW).distinct().withColumn("_out", F.lit(True))
    local = local_anomaly(table, cfg)
    return local.join(far, WINDOW, "left").withColumn("is_anomalous", F.col("is_anomalous") | F.coalesce("_out", F.lit(False))).drop("_out")


def embed_batches(chunks: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """(session_id, batch, chunk_ids): all chunks of a session in line order, a fixed number a batch."""
    placed = chunks.withColumn("_o", F.struct("line_start", "chunk_id")).withColumn("_b", F.floor(F.col("line_start") / cfg.order_block))
    numbered = number_lines(placed, ["session_id"], "_o", cfg.order_block, "_n", block="_b").withColumn("batch", F.floor((F.col("_n") - 1) / cfg.embed_batch))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("line_start", "chunk_id"))), lambda x: x["chunk_id"])
    return numbered.groupBy("session_id", "batch").agg(ids.alias("chunk_ids"))


def fan_out(chunks: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """Work items: one ENRICH_WINDOW per anomalous chunk, one EMBED_BATCH per batch of all chunks."""
    explain = chunks.where("is_anomalous").select("session_id", F.lit("ENRICH_WINDOW").alias("kind"), F.array("chunk_id").alias("chunk_ids"))
    embed = embed_batches(chunks, cfg).select("session_id", F.lit("EMBED_BATCH").alias("kind"), "chunk_ids")
    items = explain.unionByName(embed)
    return items.select(stable_id(F.col("kind"), F.array_join("chunk_ids", ",")).alias("work_id"), "session_id", "kind", "chunk_ids", F.lit(0).alias("attempt"), F.lit(0).cast("bigint").alias("not_before_epoch_ms"))


def work_item_count(chunks: DataFrame, cfg: EngineConfig = EngineConfig(), embed: bool = True) -> DataFrame:  # noqa: B008
    batches = F.ceil(F.count(F.lit(1)) / cfg.embed_batch) if embed else F.lit(0)
    return chunks.groupBy("session_id").agg((F.count_if("is_anomalous") + batches).cast("bigint").alias("items"))
