"""Findings: merged by fingerprint, ranked, joined with their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp_category, clamp_confidence, clamp_severity, findings_json, fingerprint, severity_rank
from .metrics import is_set


def parse(replies: DataFrame) -> DataFrame:
    """Finding rows from model replies (column raw); blank titles and explanations are dropped."""
    f = replies.withColumn("f", F.explode(findings_json(F.col("raw"))))
    return f.drop("raw").select("*", clamp_category(F.col("f.category")).alias("category"), clamp_severity(F.col("f.severity")).alias("severity"), F.trim("f.title").alias("title"), F.trim("f.explanation").alias("explanation"), clamp_confidence(F.col("f.confidence")).alias("confidence")).drop("f")


def merge(findings: DataFrame) -> DataFrame:
    """One row per (session, fingerprint), in the order of seq.

    Occurrences count up; evidence is the distinct union; the range widens; the first title and category
    stay; the last explanation, severity and confidence win.
    """
    key = ["session_id", "fingerprint"]
    f = findings.withColumn("fingerprint", fingerprint(F.col("category"), F.col("title")))
    merged = f.groupBy(*key).agg(
        F.count(F.lit(1)).cast("int").alias("occurrence_count"), F.min_by("title", "seq").alias("title"), F.min_by("category", "seq").alias("category"),
        F.max_by("explanation", "seq").alias("explanation"), F.max_by("severity", "seq").alias("severity"), F.max_by("confidence", "seq").alias("confidence"),
        F.min("time_range_start").alias("time_range_start"), F.max("time_range_end").alias("time_range_end"), F.min("seq").alias("seq"),
    )
    # evidence is made distinct before it is gathered: a list holds each chunk once, however often it was found
    ids = f.select(*key, "seq", F.posexplode("evidence_chunk_ids").alias("pos", "chunk_id")).groupBy(*key, "chunk_id").agg(F.min("seq").alias("seq"), F.min_by("pos", "seq").alias("pos"))
    lists = ids.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("evidence_chunk_ids"))
    return merged.join(lists, key, "left").withColumn("evidence_chunk_ids", F.coalesce("evidence_chunk_ids", F.array().cast("array<string>")))


def by_time(findings: DataFrame, *last: str) -> DataFrame:
    """In the order of time, those without a start last, then by category, age and ``last``."""
    return findings.orderBy(F.col("time_range_start").asc_nulls_last(), "category", "seq", *last)


def ranked(findings: DataFrame, session_id: str | None = None, category: str | None = None, severity: str | None = None) -> DataFrame:
    """Critical first, then by start (nulls last) and age."""
    for name, value in (("session_id", session_id), ("category", category), ("severity", severity)):
        if is_set(value):
            findings = findings.where(F.col(name) == value)
    return findings.orderBy(severity_rank(F.col("severity")), F.col("time_range_start").asc_nulls_last(), "seq", "fingerprint")


def evidence(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of (owner, chunk_ids) in time and line order."""
    wanted = ids.select("owner", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    return wanted.join(chunks, "chunk_id").orderBy("owner", F.col("time_bucket").asc_nulls_last(), "line_start", "chunk_id")


def in_list_order(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of (owner, chunk_ids) in the order of the list; missing ids are skipped."""
    wanted = ids.select("owner", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    return wanted.join(chunks, "chunk_id").orderBy("owner", "pos")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def categories(metrics: DataFrame) -> DataFrame:
    return metrics.select("category").distinct().orderBy("category")
