"""Rate budgets, token buckets and key health as event-time computations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_budget(calls: DataFrame, key: str, ts: str, tokens: Column, seconds: int = 60, max_calls: int = 75, max_tokens: int = 24_000, block: int = 16) -> DataFrame:
    """Adds calls_in_window, tokens_in_window (up to this call) and admitted.

    Calls are first added up by instant. Time is cut into blocks of ``block`` windows' length; the instants of a block's last
    ``seconds`` are copied into the next one, so each block's windows are whole, and a key's blocks are shared out.
    """
    span = 1_000_000 * seconds
    width = block * span
    rows = calls.withColumns({"_at": F.unix_micros(F.col(ts)), "_t": tokens})
    sums = rows.groupBy(F.col(key).alias("_key"), F.col("_at").alias("_when")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_t").alias("_sum"))
    past = F.pmod(F.col("_when"), F.lit(width))
    sums = sums.withColumn("_own", F.call_function("div", F.col("_when") - past, F.lit(width)))
    met = sums.withColumn("_block", F.explode(F.when(past >= width - span, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy("_key", "_block").orderBy("_when").rangeBetween(-span + 1, 0)
    met = met.withColumn("calls_in_window", F.sum("_n").over(w)).withColumn("tokens_in_window", F.sum("_sum").over(w)).where(F.col("_block").eqNullSafe(F.col("_own")))
    found = met.select("_key", "_when", "calls_in_window", "tokens_in_window")
    out = rows.join(found, F.col(key).eqNullSafe(F.col("_key")) & F.col("_at").eqNullSafe(F.col("_when"))).drop("_key", "_when", "_at", "_t")
    return out.withColumn("admitted", (F.col("calls_in_window") <= max_calls) & (F.col("tokens_in_window") <= max_tokens))


def token_bucket(requests: DataFrame, key: str, ts: str, capacity: float = 15, per_second: float = 0.25) -> DataFrame:
    """(key, ts, granted, left): a bucket per key that refills steadily. Requests of a key are few and ordered."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "n"])
        level, last, granted, left = capacity, None, [], []
        for at in pdf["at"]:
            level = min(capacity, level + (0 if last is None else (at - last) / 1e6 * per_second))
            last = at
            ok = level >= 1
            level -= ok
            granted.append(bool(ok))
            left.append(round(level, 6))
        return pdf.assign(granted=granted, left=left)

    src = requests.select(F.col(key).alias("key"), F.unix_micros(F.col(ts)).alias("at"), F.monotonically_increasing_id().alias("n"))
    return src.groupBy("key").applyInPandas(fold, f"key {dict(src.dtypes)['key']}, at bigint, n bigint, granted boolean, left double").drop("n")


def key_health(outcomes: DataFrame, key: str, ts: str, ok: Column, failures: int = 3, minutes: int = 5) -> DataFrame:
    """(key, at, ok, enabled): a key is off for some minutes after so many failures in a row."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "ok"])
        row, until, out = 0, None, []
        for at, good in zip(pdf["at"], pdf["ok"], strict=True):
            if until is not None and at >= until:
                row, until = 0, None
            out.append(until is None)
            if until is None:
                row = 0 if good else row + 1
                if row >= failures:
                    until = at + minutes * 60_000_000
        return pdf.assign(enabled=out)

    src = outcomes.select(F.col(key).alias("key"), F.unix_micros(F.col(ts)).alias("at"), ok.alias("ok"))
    return src.groupBy("key").applyInPandas(fold, f"key {dict(src.dtypes)['key']}, at bigint, ok boolean, enabled boolean")


def queue(jobs: DataFrame, n: int = 2) -> DataFrame:
    """The next jobs: by priority, then age."""
    return jobs.where("status = 'QUEUED'").orderBy("priority", "created_at").limit(n)
