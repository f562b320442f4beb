r"""Quality rules by host: how often a host's documents fail each rule, shrunk towards all hosts, decides on the host.

Every document is measured once, in its own row: words, characters, symbols, repeated lines and words in repeated
five-word windows. Each rule's failures are added up by host. A host with few documents says little about itself, so
its rate is shrunk by a beta prior that is fitted to all hosts by the method of moments: ``(failed + a) / (documents
+ a + b)``. A host one of whose shrunk rates exceeds the rule's limit is rejected with all its documents; the verdicts
are joined back to the documents. A document that fails the base rules is dropped in any case.

The host is the host name of ``source`` if that is a URL, else ``source`` itself, lower-cased.

Everything is a column expression. Windows are counted by sorting each text's own windows, and only in texts where a
hash shows that any may repeat; the words themselves are compared. Of the documents only the measurements are
written; the shuffle carries one row for each host and task. Verdicts reach the documents by a broadcast if there are
at most ``BROADCAST_HOSTS`` hosts, else by a join whose documents are dealt over ``SALTS`` copies of each verdict.

Defined results: a null text has no words and fails the base rules; a null source is no host, its documents are
judged by the base rules alone; repeated rows count as often as they occur; an empty table gives an empty one. Only
the three named columns are read, further columns of any name are not. A very long text is measured in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed patterns: gaps between words, a character of a word, what is no symbol.
GAP, INK, NO_SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[^#*$%&|<>]+"
#: Words of a window; least words; largest share, in percent, of words in repeated windows.
GRAM, MIN_WORDS, MAX_REPEATED = 5, 10, 20
#: Rules by name: what fails a document (of the measurements), and the shrunk rate above which a host is rejected.
RULES: dict[str, tuple[str, float]] = {
    "too_short": ("n_words < 10", 0.5),
    "repetition": ("100 * n_repeat_words > 20 * n_words", 0.5),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "same_lines": ("10 * n_dup_lines > 3 * n_lines", 0.5),
    "word_length": ("word_chars < 2 * n_words or word_chars > 15 * n_words", 0.5),
}
#: Least and largest weight of the prior, in documents. The least keeps a few documents from deciding on a host; the
#: largest is used where the hosts' rates are all alike.
MIN_WEIGHT, MAX_WEIGHT = 10.0, 1000.0
BROADCAST_HOSTS, SALTS = 100_000, 32


def host(source: Column) -> Column:
    """Host name of a URL, else the value itself; lower-cased, null if there is none."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), source))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of (doc_id, text, source)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), host(F.col("source")).alias("host"), text.alias("t"), F.array_remove(F.split(text, GAP), "").alias("w"))
    rows = rows.select(
        "doc_id", "host", "w", F.size("w").alias("n"), F.length(F.array_join("w", "")).alias("word_chars"), F.length(F.regexp_replace("t", NO_SYMBOL, "")).alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(INK)).alias("lines"),
        # a window is known by a hash here; where two agree, the next step compares the words
        F.when(F.size("w") > GRAM, F.transform(F.sequence(F.lit(0), F.size("w") - GRAM), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(GRAM)]))).alias("h"),
    )
    same = F.size(F.array_distinct("h")) < F.size("h")
    window = lambda i: F.struct(F.concat_ws(" ", F.slice("w", i + 1, GRAM)).alias("key"), i.alias("at"))
    rows = rows.withColumn("s", F.when(F.col("h").isNotNull() & same, F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n") - GRAM), window))))
    alike = lambda x, k: F.coalesce(F.get(F.col("s"), k)["key"] == x["key"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("s", lambda x, k: alike(x, k - 1) | alike(x, k + 1)), lambda x: x["at"]))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-GRAM).alias("last"))
    covered = F.aggregate(places, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(GRAM), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return rows.select(
        "doc_id", "host", F.col("n").cast("bigint").alias("n_words"), F.col("word_chars").cast("bigint").alias("word_chars"), F.col("n_symbols").cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("s").isNull(), F.lit(0).cast("bigint")).otherwise(covered).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def verdicts(measured: DataFrame, rules: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """(host, n_docs, failed_<rule>, rate_<rule>, rejected): one row for each host.

    The prior of a rule: with hosts' rates p_h of n_h documents, their mean m and variance s (both weighted by n_h), a
    and b are m and 1 - m times the weight (m (1 - m) - s) / (s - m (1 - m) k / n), k hosts and n documents, which takes
    the scatter of small hosts out of s; it is kept from MIN_WEIGHT to MAX_WEIGHT, and MAX_WEIGHT if not positive.
    """
    rules = RULES if rules is None else rules
    hosts = measured.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.expr(test)).alias(f"failed_{r}") for r, (test, _) in rules.items()])
    hosts = written(hosts, "hosts")
    sums = [F.sum("n_docs").cast("double").alias("n"), F.count(F.lit(1)).cast("double").alias("k")]
    for r in rules:
        sums += [F.sum(f"failed_{r}").cast("double").alias(f"f_{r}"), F.sum(F.col(f"failed_{r}") * F.col(f"failed_{r}") / F.col("n_docs").cast("double")).alias(f"q_{r}")]
    prior, weights = hosts.agg(*sums).first(), {}
    for r in rules:
        n, k = prior["n"] or 1.0, prior["k"]
        m = (prior[f"f_{r}"] or 0.0) / n
        spread, even = (prior[f"q_{r}"] or 0.0) / n - m * m, m * (1 - m)
        beyond = spread - even * k / n
        weights[r] = (m, max(MIN_WEIGHT, min((even - spread) / beyond, MAX_WEIGHT)) if beyond > 0 and even > spread else MAX_WEIGHT)
    every = hosts.withColumns({f"rate_{r}": (F.col(f"failed_{r}") + F.lit(m * w)) / (F.col("n_docs") + F.lit(w)) for r, (m, w) in weights.items()})
    rejected = F.lit(False)
    for r, (_, limit) in rules.items():
        rejected = rejected | (F.col(f"rate_{r}") > limit)
    return every.select("host", "n_docs", *[f"failed_{r}" for r in rules], *[f"rate_{r}" for r in rules], rejected.alias("rejected"))


def judge(docs: DataFrame, rules: dict[str, tuple[str, float]] | None = None, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(doc_id, host, measurements, base_failed, host_rejected, kept), one row for each document."""
    measured = written(measure(docs), "measured")
    found = written(verdicts(measured, rules), "verdicts").select("host", "rejected")
    if found.count() <= broadcast_hosts:  # some 50 bytes each
        joined = measured.join(F.broadcast(found), "host", "left")
    else:
        copies = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.withColumn("salt", F.pmod(F.xxhash64(*measured.columns), F.lit(SALTS)).cast("int")).join(copies, ["host", "salt"], "left").drop("salt")
    gone = F.coalesce(F.col("rejected"), F.lit(False))
    return joined.select(*measured.columns, base_failed().alias("base_failed"), gone.alias("host_rejected"), (~base_failed() & ~gone).alias("kept"))


def _oracle() -> str:
    tests = ", ".join(f"count(*) filter (where {test}) as failed_{r}" for r, (test, _) in RULES.items())
    sums = ", ".join(f"sum(failed_{r})::double as f_{r}, sum(failed_{r} * failed_{r} / n_docs::double) as q_{r}" for r in RULES)
    means = ", ".join(f"f_{r} / n as m_{r}, q_{r} / n - (f_{r} / n) * (f_{r} / n) as s_{r}" for r in RULES)
    evens = ", ".join(f"m_{r}, s_{r}, m_{r} * (1 - m_{r}) as e_{r}, s_{r} - m_{r} * (1 - m_{r}) * k / n as b_{r}" for r in RULES)
    weights = ", ".join(f"m_{r}, case when b_{r} > 0 and e_{r} > s_{r} then greatest({MIN_WEIGHT}, least((e_{r} - s_{r}) / b_{r}, {MAX_WEIGHT})) else {MAX_WEIGHT} end as w_{r}" for r in RULES)
    bad = " or ".join(f"(failed_{r} + m_{r} * w_{r}) / (n_docs + w_{r}) > {limit}" for r, (_, limit) in RULES.items())
    return rf"""
    with t as (
        select row_number() over () as rid, doc_id, coalesce(text, '') as txt,
            lower(coalesce(nullif(regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), ''), source)) as host
        from documents
    ), u as (
        select rid, doc_id, host, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
            length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')) as n_symbols
        from t
    ), v as (
        select rid, i, count(*) over (partition by rid, list_slice(w, i, i + 4)) as times
        from (select rid, w, unnest(generate_series(1, len(w) - 4)) as i from u where len(w) > 5)
    ), c as (
        select rid, sum(least(5, coalesce(i - before, 5))) as covered
        from (select rid, i, lag(i) over (partition by rid order by i) as before from v where times > 1) group by rid
    ), m as (
        select doc_id, host, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, n_symbols::bigint as n_symbols, len(lines)::bigint as n_lines,
            (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered, 0)::bigint as n_repeat_words
        from u left join c using (rid)
    ), h as (select host, count(*) as n_docs, {tests} from m where host is not null group by host),
    p as (select sum(n_docs)::double as n, count(*)::double as k, {sums} from h),
    p1 as (select n, k, {means} from p), p2 as (select {evens} from p1), p3 as (select {weights} from p2),
    r as (select host, ({bad}) as rejected from h, p3),
    j as (select m.*, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words as base_failed, coalesce(rejected, false) as rejected from m left join r using (host))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept from j"""


ORACLE = _oracle()
