"""Schemas of the engine's tables and messages."""

from __future__ import annotations

CHUNKS = "session_id string, chunk_id string, document_id string, time_bucket timestamp, line_start bigint, line_end bigint, content string, embedding array<float>, is_anomalous boolean, created_at timestamp"
METRICS = "session_id string, time_bucket timestamp, category string, metric string, count bigint, sum_ms bigint, avg_ms decimal(12,2), p95_ms decimal(12,2), sample_chunk_ids array<string>"
FINDINGS = "id string, session_id string, category string, severity string, title string, explanation string, evidence_chunk_ids array<string>, time_range_start timestamp, time_range_end timestamp, fingerprint string, occurrence_count int, confidence decimal(3,2), created_at timestamp"
INCIDENTS = "id string, session_id string, time_range_start timestamp, time_range_end timestamp, finding_ids array<string>, narrative string, root_cause_hypothesis string, created_at timestamp"
REPORTS = "session_id string, generated_at timestamp, content_md string, content_json string"
MESSAGES = "id string, session_id string, question string, answer string, citations array<string>, created_at timestamp"
SESSIONS = "id string, user_id string, title string, analysis_status string, total_windows int, enriched_windows int, error_message string, created_at timestamp, updated_at timestamp"
INGEST_PARTS = "document_id string, part_idx int, processed_at timestamp"
ENRICH_REQUEST = "work_id string, session_id string, kind string, chunk_ids array<string>, attempt int, not_before_epoch_ms bigint"
FINDING_JSON = "struct<category:string,severity:string,title:string,explanation:string,confidence:double>"
#: The session's life in order, and the states that end it.
STATUSES = ("CREATED", "CHUNKING", "PARSING", "ENRICHING", "CORRELATING", "REPORTING", "DONE", "FAILED")
TERMINAL = ("DONE", "FAILED")
