"""Timestamps out of log lines, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _match(line: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def iso_ts(line: Column) -> Column:
    """The first ISO match anywhere; UTC unless it has an offset. Offsets without a colon do not parse."""
    text = _match(line, P.ISO)
    clean = F.translate(text, ", ", ".T")
    zoned = clean.rlike(r"(?:Z|[+-]\d{2}:\d{2})$")
    bad = clean.rlike(r"[+-]\d{4}$")
    micros = F.regexp_replace(clean, r"(\.\d{6})\d+", "$1")
    return F.when(bad, None).when(zoned, F.try_to_timestamp(micros)).otherwise(F.try_to_timestamp(F.concat(micros, F.lit("Z"))))


def syslog_ts(line: Column, year: int) -> Column:
    """``Mon dd hh:mm:ss`` at the start, the day two wide; the day is clamped to the month's last."""
    text = _match(line, P.SYSLOG)
    ok = text.rlike(r"^[A-Z][a-z]{2} (?:\d\d| \d) \d\d:\d\d:\d\d$")
    month = F.array_position(F.array(*[F.lit(m) for m in P.MONTHS]), F.substring(text, 1, 3)).cast("int")
    day = F.trim(F.substring(text, 5, 2)).try_cast("int")
    hour, minute, second = (F.substring(text, p, 2).try_cast("int") for p in (8, 11, 14))
    valid = ok & (month > 0) & day.between(1, 31) & (hour < 24) & (minute < 60) & (second < 60)
    first = F.make_date(F.lit(year), F.when(valid, month), F.lit(1))
    last = F.dayofmonth(F.last_day(first))
    # only February's 29th is clamped; other days past the month's end do not parse
    fits = valid & ((day <= last) | ((month == 2) & (day <= 29)))
    return F.when(fits, F.make_timestamp(F.lit(year), month, F.least(day, last), hour, minute, second.cast("decimal(16,6)"), F.lit("UTC")))


def line_ts(line: Column, year: int) -> Column:
    return F.coalesce(iso_ts(line), syslog_ts(line, year))


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window; floors also before 1970."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / F.lit(1_000_000 * seconds)) * seconds)


def is_record_start(line: Column) -> Column:
    return line.rlike(P.RECORD_START)
