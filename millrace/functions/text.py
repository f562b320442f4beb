"""Scalar text functions of the engine, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FINDING_JSON
from . import patterns as P

SEVERITIES = ("INFO", "WARN", "ERROR", "CRITICAL")


def first_group(line: Column, *patterns: tuple[str, int]) -> Column:
    """Group of the first pattern that matches with a non-empty group."""
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, g), F.lit("")) for p, g in patterns])


def simple_name(fqcn: Column) -> Column:
    return F.substring_index(fqcn, ".", -1)


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"\d+", ""), r"\s+", " "))


def fingerprint(category: Column, title: Column) -> Column:
    return F.sha2(F.concat(F.upper(F.trim(category)), F.lit("|"), normal_title(title)), 256)


def exception_fingerprint(cls: Column, frames: Column) -> Column:
    """Class and up to three frames."""
    return F.sha2(F.concat_ws("|", cls, *[F.coalesce(F.get(frames, F.lit(k)), F.lit("")) for k in range(3)]), 256)


def clamp_severity(raw: Column) -> Column:
    up = F.upper(F.trim(raw))
    return F.when(up.isin(*SEVERITIES), up).otherwise("WARN")


def clamp_category(raw: Column) -> Column:
    up = F.upper(F.trim(raw))
    return F.when(F.length(up) > 0, F.substring(up, 1, 30)).otherwise("GENERAL")


def clamp_confidence(raw: Column) -> Column:
    return F.when(raw.isNull() | F.isnan(raw), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).cast("decimal(3,2)"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 0).when(severity == "ERROR", 1).when(severity == "WARN", 2).otherwise(3)


def strip_fences(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def findings_json(raw: Column) -> Column:
    """Array of findings from an array, a single object, either of them fenced or within other text; else empty."""
    clean = strip_fences(raw)
    array = F.regexp_extract(clean, r"(?s)(\[.*\])", 1)
    single = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
    many = F.from_json(F.nullif(array, F.lit("")), f"array<{FINDING_JSON}>")
    one = F.from_json(F.nullif(single, F.lit("")), FINDING_JSON)
    found = F.coalesce(F.when(clean.startswith("{"), F.array(one)), many, F.when(one.isNotNull(), F.array(one)), F.expr(f"cast(array() as array<{FINDING_JSON}>)"))
    return F.filter(found, lambda x: (F.length(F.trim(x["title"])) > 0) & (F.length(F.trim(x["explanation"])) > 0))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(P.UUID), F.lit(False))


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id from its parts: the same on every recomputation."""
    h = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def embed_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long") + 8


def chat_tokens(system: Column, user: Column, output: int = 512) -> Column:
    """Estimated tokens of a chat call, its answer included."""
    return F.floor((F.length(system) + F.length(user)) / 4).cast("long") + output


def object_key(url: Column, bucket: str) -> Column:
    """Key of an object of the bucket; null for any other address."""
    prefix = f"s3://{bucket}/"
    return F.when(url.startswith(prefix), F.substring(url, F.lit(len(prefix) + 1), F.length(url)))


def truncated(message: Column, size: int = 500) -> Column:
    """The start of an error's text."""
    return F.substring(message, 1, size)


def reply_lane(status: Column, attempt: Column, attempts: int = 3) -> Column:
    """What follows a model server's reply (status null: no connection): DONE, a RETRY_LANE for rate limits, FAIL for what will
    not change, and after other errors a BACKOFF of 1, 2, 4, … seconds until the attempts are used up."""
    again = F.when(attempt + 1 < attempts, "BACKOFF").otherwise("FAIL")
    return F.when(status.between(200, 399), "DONE").when(status == 429, "RETRY_LANE").when(status < 500, "FAIL").otherwise(again)


def plain_number(x: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def metric_line(category: Column, metric: Column, count: Column, avg: Column, p95: Column) -> Column:
    """``CATEGORY.metric count=n avg=xms p95=yms``; latencies only where they exist."""
    latency = F.when(p95.isNotNull(), F.concat(F.lit(" avg="), plain_number(avg), F.lit("ms p95="), plain_number(p95), F.lit("ms"))).otherwise("")
    return F.concat(category, F.lit("."), metric, F.lit(" count="), count.cast("string"), latency)


def terms(text: Column) -> Column:
    """Lower-cased words, as the ``simple`` text-search configuration has them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), 1)


def error_category(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(m.rlike(r"429|rate limit|quota|too many requests"), "RATE_LIMIT")
        .when(m.rlike(r"leaked"), "LEAKED_KEY")
        .when(m.rlike(r"403|forbidden|permission"), "FORBIDDEN")
        .when(m.rlike(r"401|unauthor|invalid api key"), "UNAUTHORIZED")
        .when(m.rlike(r"timeout|timed out"), "TIMEOUT")
        .when(m.rlike(r"connection|refused|unreachable"), "CONNECTION")
        .otherwise("UNKNOWN")
    )


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.format_number(n / 1024, 1), F.lit(" KB"))).when(n < 1 << 30, F.concat(F.format_number(n / (1 << 20), 1), F.lit(" MB"))).otherwise(F.concat(F.format_number(n / (1 << 30), 2), F.lit(" GB")))


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.round(100 * done / total).cast("int"))).otherwise(0)


def lane(work_id: Column, slots: int) -> Column:
    """Partition of a work item; never negative."""
    return (F.conv(F.substring(F.md5(work_id.cast("binary")), 1, 8), 16, 10).cast("bigint") % slots).cast("int")
