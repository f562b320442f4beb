"""Metric rules compiled into one aggregate over lines, and everything computed from metric rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import patterns as P
from ..functions.text import first_group, metric_line, simple_name
from .intervals import interval_join
from .windows import KEYS

WINDOW = [*KEYS, "time_bucket", "line_start"]


@dataclass(frozen=True)
class MetricRule:
    """Lines where ``when`` holds; a latency rule also takes samples (null: no sample)."""

    category: str
    metric: str
    when: str
    sample: str | None = None
    anomalous: bool = False

    @property
    def column(self) -> str:
        return f"{self.category}.{self.metric}"


#: Feature columns that rules refer to: each pattern is matched once a line.
FLAGS = {
    "query": P.QUERY, "deadlock": P.DEADLOCK, "timed_out": P.TIMEOUT, "pool": P.POOL, "failure": P.FAILURE,
    "slow": P.SLOW, "error_level": P.ERROR_LEVEL, "fatal_level": P.FATAL_LEVEL, "unauthorized": P.UNAUTHORIZED,
    "forbidden": P.FORBIDDEN, "auth_fail": P.AUTH_FAIL, "token_expired": P.TOKEN_EXPIRED, "oom": P.OOM,
    "memory_warn": P.MEMORY_WARN, "thread_pool": P.THREAD_POOL, "startup": P.STARTUP, "shutdown": P.SHUTDOWN,
    "deploy": P.DEPLOY, "config_reload": P.CONFIG_RELOAD, "health_fail": P.HEALTH_FAIL, "request": P.REQUEST,
    "warn": P.WARN,
}
#: Words without one of which, in the lower-cased line, a flag's pattern cannot match: most lines are told by them.
NEEDS = {
    "query": ("select", "insert", "update", "delete", "merge", "executing query", "hibernate:"),
    "deadlock": ("deadlock",),
    "timed_out": ("timeout",),
    "pool": ("pool", "unable to acquire", "connection is not available"),
    "failure": ("sqlexception", "sqlstate", "constraint violation", "could not ", "ora-", "duplicate key"),
    "slow": ("slow query", "slow sql"),
    "error_level": ("error", "fatal", "severe"),
    "fatal_level": ("fatal", "severe"),
    "unauthorized": ("401", "unauthorized"),
    "forbidden": ("403", "forbidden", "access denied"),
    "auth_fail": ("auth", "credentials", "invalid password", "login failed"),
    "token_expired": ("expired",),
    "oom": ("outofmemoryerror", "out of memory", "oomkilled", "heap space", "gc overhead limit"),
    "memory_warn": ("memory", "heap"),
    "thread_pool": ("thread", "task rejected", "rejectedexecution", "queue "),
    "startup": ("start", "jvm running", "springapplication"),
    "shutdown": ("shut", "stopping "),
    "deploy": ("deploy", "new version", "rolling out", "release "),
    "config_reload": ("config", "refreshing ", "reloaded properties"),
    "health_fail": ("health", "liveness", "readiness", "status"),
    "request": ("/", "incoming request", "request received"),
    "warn": ("warn",),
}
RULES: tuple[MetricRule, ...] = (
    MetricRule("API", "api_calls", "path is not null"),
    MetricRule("API", "ff_api_calls", "path is not null and lower(path) rlike 'flag|feature'"),
    MetricRule("API", "api_2xx", "path is not null and status between 200 and 299"),
    MetricRule("API", "api_4xx", "path is not null and status between 400 and 499"),
    MetricRule("API", "api_5xx", "path is not null and status >= 500"),
    MetricRule("API", "api_latency_ms", "path is not null and latency is not null", "latency"),
    MetricRule("DATABASE", "sql_queries", "query"),
    MetricRule("DATABASE", "sql_latency_ms", "query and sql_latency is not null", "sql_latency"),
    MetricRule("DATABASE", "slow_queries", "slow"),
    MetricRule("DATABASE", "sql_deadlocks", "deadlock", anomalous=True),
    MetricRule("DATABASE", "sql_timeouts", "timed_out", anomalous=True),
    MetricRule("DATABASE", "pool_events", "pool", anomalous=True),
    MetricRule("DATABASE", "sql_failures", "failure"),
    MetricRule("ERRORS", "errors", "error_level", anomalous=True),
    MetricRule("ERRORS", "fatal", "fatal_level"),
    MetricRule("ERRORS", "exceptions", "exception is not null", anomalous=True),
    MetricRule("AUTH", "auth_401", "unauthorized"),
    MetricRule("AUTH", "auth_403", "forbidden"),
    MetricRule("AUTH", "auth_failures", "auth_fail"),
    MetricRule("AUTH", "token_expired", "token_expired"),
    MetricRule("PERFORMANCE", "gc_pause_ms", "gc_pause is not null", "gc_pause"),
    MetricRule("PERFORMANCE", "oom", "oom", anomalous=True),
    MetricRule("PERFORMANCE", "memory_warnings", "memory_warn"),
    MetricRule("PERFORMANCE", "thread_pool_saturation", "thread_pool", anomalous=True),
    MetricRule("LIFECYCLE", "restarts", "startup"),
    MetricRule("LIFECYCLE", "shutdowns", "shutdown"),
    MetricRule("LIFECYCLE", "deploys", "deploy"),
    MetricRule("LIFECYCLE", "config_reloads", "config_reload"),
    MetricRule("LIFECYCLE", "health_check_failures", "health_fail", anomalous=True),
    MetricRule("TRAFFIC", "lines", "true"),
    MetricRule("TRAFFIC", "requests", "request"),
)


def features(runs: DataFrame) -> DataFrame:
    """One row per line with every flag, group and number the rules use."""
    line, low = F.col("value"), F.col("_low")
    number = lambda c: c.try_cast("double")

    def holds(*words: str) -> Column:
        out = low.contains(words[0])
        for w in words[1:]:
            out = out | low.contains(w)
        return out

    cols = {k: holds(*NEEDS[k]) & line.rlike(p) for k, p in FLAGS.items()}
    ms = holds("ms")
    gc_pause = F.when(ms & holds("gc", "garbage collect", "pause"), first_group(line, (P.GC_PAUSE, 1), (P.GC_PAUSE, 2)))
    cols |= {
        "path": F.when(holds("/") & line.rlike(P.METHOD_PATH), F.regexp_extract(line, P.METHOD_PATH, 2)),
        "status": F.when(holds("status", "response", "code", "http/"), first_group(line, (P.STATUS_LABELLED, 1), (P.STATUS_HTTP, 1))).try_cast("int"),
        "latency": F.when(ms, first_group(line, (P.LATENCY_LABELLED, 1), (P.LATENCY_BARE, 1))).try_cast("bigint"),
        "sql_latency": F.when(ms & holds("query", "sql", "statement", "db"), first_group(line, (P.QUERY_LATENCY, 1))).try_cast("bigint"),
        "exception": F.when(holds("exception", "error", "throwable"), first_group(line, (P.EXCEPTION, 1))),
        "gc_pause": F.floor(number(gc_pause) + 0.5).cast("bigint"),
    }
    return runs.withColumn("_low", F.lower(line)).withColumns(cols).drop("_low")


def _numbers(rule: MetricRule) -> list[Column]:
    hit = F.expr(rule.when)
    out = [F.count_if(hit).alias(f"{rule.column}.n")]
    if rule.sample:
        x = F.when(hit, F.expr(rule.sample))
        out += [F.sum(x).alias(f"{rule.column}.sum"), F.percentile_disc(F.lit(0.95), x).alias(f"{rule.column}.p95") if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc(0.95) within group (order by case when {rule.when} then {rule.sample} end)").alias(f"{rule.column}.p95")]
    return out


def window_table(feats: DataFrame, rules: Sequence[MetricRule] = RULES, extra: Sequence[MetricRule] = (), content: bool = False) -> DataFrame:
    """One wide row per window (exception_class is null): every rule's numbers, WARN lines, and the text if asked for;
    beside it one row per window and exception class. A single aggregate: a line with an exception counts in both.
    """
    every = [*rules, *extra]
    intrinsic = " or ".join(f"({r.when})" for r in every if r.anomalous)
    none = F.lit(None).cast("string")
    rows = feats.withColumn("_class", F.explode(F.when(F.col("exception").isNull(), F.array(none)).otherwise(F.array(none, simple_name(F.col("exception"))))))
    line = F.when(F.col("_class").isNull(), F.struct("line_no", "value"))
    text = [F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["value"]), "\n").alias("content")] if content else []
    return rows.groupBy(*WINDOW, F.col("_class").alias("exception_class")).agg(
        F.max("line_no").alias("line_end"),
        *[c for r in every for c in _numbers(r)],
        F.count(F.lit(1)).alias("rows"),
        F.count_if("warn").alias("warn_lines"),
        F.bool_or(F.expr(f"coalesce({intrinsic}, false)")).alias("intrinsic"),
        *text,
    )


def average(total: Column, n: Column) -> Column:
    """Mean with two decimals, halves up, in whole numbers throughout."""
    return (F.floor((200 * total + n) / (2 * n)) / 100).cast("decimal(12,2)")


def long_metrics(table: DataFrame, rules: Sequence[MetricRule] = RULES, extra: Sequence[MetricRule] = ()) -> DataFrame:
    """Metric rows with a count above 0: window, category, metric, count, sum_ms, avg_ms, p95_ms."""
    def entry(r: MetricRule) -> Column:
        n = F.col(f"`{r.column}.n`")
        total, p95 = (F.col(f"`{r.column}.sum`").cast("bigint"), F.col(f"`{r.column}.p95`").cast("decimal(12,2)")) if r.sample else (F.lit(None).cast("bigint"), F.lit(None).cast("decimal(12,2)"))
        avg = F.when(n > 0, average(total, n)) if r.sample else F.lit(None).cast("decimal(12,2)")
        return F.struct(F.lit(r.category).alias("category"), F.lit(r.metric).alias("metric"), n.alias("count"), total.alias("sum_ms"), avg.alias("avg_ms"), p95.alias("p95_ms"))

    rows = table.select(*WINDOW, F.explode(F.array(*[entry(r) for r in [*rules, *extra]])).alias("m"))
    return rows.select(*WINDOW, "m.*").where("count > 0")


def exception_metrics(summary: DataFrame) -> DataFrame:
    """Rows ``exception:<SimpleName>`` of each window, from the summary's rows by class."""
    none = F.lit(None)
    rows = summary.where("exception_class is not null")
    return rows.select(*WINDOW, F.lit("ERRORS").alias("category"), F.concat(F.lit("exception:"), "exception_class").alias("metric"), F.col("rows").alias("count"), none.cast("bigint").alias("sum_ms"), none.cast("decimal(12,2)").alias("avg_ms"), none.cast("decimal(12,2)").alias("p95_ms"))


def merge_metrics(rows: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """Additive merge on (session, bucket, category, metric) of rows with sample_chunk_ids, in the order of seq.

    Counts and sums add up, p95 is the largest, the average follows from the sums, the first ``sample_cap``
    ids stay. A key merged from several rows has 0 where its numbers were null.
    """
    key = ["session_id", "time_bucket", "category", "metric"]
    # the first rows of a key, in two rounds, so that a key's samples meet in rows of bounded size
    spread = rows.withColumn("_part", F.pmod(F.xxhash64("seq"), F.lit(64)))
    first = F.slice(F.array_sort(F.collect_list(F.struct("seq", F.slice("sample_chunk_ids", 1, cfg.sample_cap).alias("ids")))), 1, cfg.sample_cap)
    sums = lambda n: [F.sum(n).alias("_k"), F.sum("count").alias("count"), F.sum("sum_ms").alias("sum_ms"), F.max("avg_ms").alias("avg_ms"), F.max("p95_ms").alias("p95_ms")]
    parts = spread.groupBy(*key, "_part").agg(*sums(F.lit(1)), first.alias("_ids"))
    ids = F.slice(F.flatten(F.transform(F.array_sort(F.flatten(F.collect_list("_ids"))), lambda x: x["ids"])), 1, cfg.sample_cap)
    m = parts.groupBy(*key).agg(*sums("_k"), ids.alias("sample_chunk_ids")).withColumnsRenamed({"sum_ms": "_sum", "avg_ms": "_avg", "p95_ms": "_p95"})
    many = F.col("_k") > 1
    total = F.when(many, F.coalesce("_sum", F.lit(0))).otherwise(F.col("_sum"))
    avg = F.when(many, average(F.coalesce("_sum", F.lit(0)), F.col("count"))).otherwise(F.col("_avg"))
    p95 = F.when(many, F.coalesce("_p95", F.lit(0).cast("decimal(12,2)"))).otherwise(F.col("_p95"))
    return m.select(*key, "count", total.alias("sum_ms"), avg.alias("avg_ms"), p95.alias("p95_ms"), "sample_chunk_ids")


def is_set(value: str | None) -> bool:
    return value is not None and value.strip() != ""


def metrics_query(metrics: DataFrame, session_id: str, category: str | None = None, metric: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a session, optionally of one category or metric and from ``start`` up to but not at ``end``."""
    out = metrics.where(F.col("session_id") == session_id)
    if is_set(category):
        out = out.where(F.col("category") == category)
    if is_set(metric):
        out = out.where(F.col("metric") == metric)
    if is_set(start):
        out = out.where(F.col("time_bucket") >= F.lit(start).cast("timestamp"))
    if is_set(end):
        out = out.where(F.col("time_bucket") < F.lit(end).cast("timestamp"))
    return out.orderBy("time_bucket", "category", "metric")


def top_metrics(metrics: DataFrame, limit: int = 40) -> DataFrame:
    """The metrics with the largest totals of each session's rows; ties by name."""
    sums = metrics.groupBy("category", "metric").agg(F.sum("count").alias("total"), F.max("p95_ms").alias("max_p95"), F.max("avg_ms").alias("max_avg"))
    return sums.orderBy(F.desc("total"), "category", "metric").limit(limit)


def metric_context(ranges: DataFrame, metrics: DataFrame) -> DataFrame:
    """``ranges`` (session_id, range_id, lo, hi) with a text line for each metric row of the closed range; met by time bins."""
    m = metrics.select("session_id", "time_bucket", "category", "metric", "count", "avg_ms", "p95_ms")
    hit = interval_join(ranges, m, ["session_id"], "lo", "hi", "time_bucket")
    return hit.select("session_id", "range_id", "time_bucket", "category", "metric", metric_line(F.col("category"), F.col("metric"), F.col("count"), F.col("avg_ms"), F.col("p95_ms")).alias("line"))
