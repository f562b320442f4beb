"""Settings of the log engine; the defaults are the values its results are defined with."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    window_seconds: int = 60
    warn_threshold: int = 5
    latency_multiplier: float = 3.0
    fallback_lines: int = 500
    part_bytes: int = 5_242_880
    part_lines: int = 5000
    hard_part_factor: int = 4
    embed_batch: int = 10
    max_content_chars: int = 5000
    output_tokens: int = 512
    embed_request_tokens: int = 10_000
    embed_text_chars: int = 8000
    cluster_gap_seconds: int = 300
    rrf_k: int = 60
    retrieve_limit: int = 30
    top_metrics: int = 40
    #: Metrics that a report lists, and incidents that one prompt holds.
    report_rows: int = 25
    sample_cap: int = 20
    correlate_attempts: int = 3
    max_rewrites: int = 2
    retry_delay_seconds: int = 60
    retry_max_attempts: int = 1440
    ingest_attempts: int = 3
    syslog_year: int = 2024
    embed_dim: int = 768
    #: Lines of one block of the two-level ordered operators; bounds what one task orders.
    order_block: int = 10_000
