r"""Personal data: fixed base spans, and further spans that boosted trees select among generated candidates.

Base spans follow four fixed patterns. High-recall generators propose more, overlapping candidates; gradient
boosted trees, trained here on the corpus's own candidates (those that a validator confirms or refutes), see
only their format and context, not what proposed them; thresholds calibrated for each kind on other rows select the redactions.
Everything runs as SQL expressions and Spark ML inside the JVM.

Defined results: a null text is the empty text and has no spans; starts and ends are code points; an empty
table, or one whose candidates are all of one class, yields base spans only. Repeated rows are treated alike.
The patterns look one or two characters back, or start where the last match ended, in place of trying each
start inside a run again: the same leftmost matches, in time linear in the text.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Order in which kinds sort at one start; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole run of 14 to 19 digits with single separators; shorter and longer runs are no cards.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: Generators of candidates: (name, kind, pattern, what a text must hold for the pattern to be tried). Runs have no
#: upper bound, so that a candidate is never a part of a longer token.
GENERATORS = (
    ("key_value", "secret", r"(?i)(?<![A-Za-z])(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?[^\s\"']{4,}+", "[=:]"),
    ("access_key", "secret", r"(?<![A-Za-z0-9])[A-Z]{3}[0-9A-Z]{14,}+(?![A-Za-z0-9])", "[0-9]"),
    ("local_phone", "phone", r"(?<![0-9])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "[0-9]"),
    ("triple", "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]"),
    ("account", "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[0-9]"),
    ("written_mail", "email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++", r"[\[(]"),
    ("digits", "card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){8,}+", "[0-9]"),
    ("dotted", "ip", r"(?<![0-9.])[0-9]++(?:\.[0-9]++)++", "[0-9]"),
    ("plus", "phone", r"\+[0-9][\x20().0-9-]{3,}+", r"\+"),
    ("at", "email", r"(?<![^\s])[^\s@]++@[^\s@]++", "@"),
)
#: Most candidate rows that the trees are fitted on; the calibration rows are as many at most.
FIT_ROWS = 20_000
TREES, DEPTH, PRECISION = 8, 3, 0.98
_HIT = "struct<pat:int,pos:int,gap:int,len:int,s:string,l:string,r:string>"
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
_CLASS = {"digit": "[0-9]", "lower": "[a-z]", "upper": "[A-Z]", "space": r"\s"}


def _hits(text: str, pat: int, pattern: str, guard: str) -> Column:
    """Matches of a pattern with the length of the gap before each, and 24 and 8 characters of context."""
    p = F.lit(pattern)
    found = F.struct(F.regexp_extract_all(F.col(text), p, F.lit(0)).alias("m"), F.split(F.col(text), pattern, -1).alias("g"))
    rows = F.transform(found["m"], lambda x, i: F.struct(F.lit(pat).alias("pat"), i.alias("pos"), F.length(found["g"][i]).alias("gap"), F.length(x).alias("len"), x.alias("s"), F.right(found["g"][i], F.lit(24)).alias("l"), F.left(found["g"][i + 1], F.lit(8)).alias("r")))
    return F.when(F.col(text).rlike(guard), rows).otherwise(F.array().cast(f"array<{_HIT}>"))


_DIGITS = "regexp_replace({s}, '[^0-9]', '')"
#: Luhn: from the right, every second digit is doubled, and nine taken from what exceeds nine.
_LUHN = f"""aggregate(sequence(1, greatest(length({_DIGITS}), 1)), 0, (a, i) -> a + (
    (cast(substr({_DIGITS}, -i, 1) as int) * if(i % 2 = 0, 2, 1)) - if(i % 2 = 0 and cast(substr({_DIGITS}, -i, 1) as int) > 4, 9, 0))) % 10 = 0"""
_VALID = {
    "email": "true",
    "ip": "forall(split({s}, '[.]'), x -> length(ltrim('0', x)) <= 3 and coalesce(try_cast(ltrim('0', x) as int), 0) <= 255)",
    "card": f"length({_DIGITS}) between 14 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
#: Check digits of an account number: its first four characters put last, letters as numbers, modulo 97.
_CLEAN = "regexp_replace({s}, ' ', '')"
_MOD_97 = f"aggregate(filter(split(concat(substr({_CLEAN}, 5), left({_CLEAN}, 4)), ''), x -> x <> ''), 0, (a, x) -> if(x rlike '[A-Z]', (a * 100 + ascii(x) - 55) % 97, (a * 10 + coalesce(try_cast(x as int), 0)) % 97)) = 1"
#: What confirms a generated candidate; only the training labels come from it.
_CONFIRMS = {
    "key_value": "{s} rlike '[0-9]' and {s} rlike '[=:].*[A-Za-z]' and length(regexp_replace({s}, '^[^=:]*[=:]', '')) >= 10",
    "access_key": "{s} rlike '^AKIA[0-9A-Z]{{16}}$'",
    "local_phone": "{l} rlike '(?i)(tel|phone|call|fax|mobile)[^0-9]*$' or {s} rlike '^[(]'",
    "triple": "substr({s}, 1, 3) not in ('000', '666') and substr({s}, 1, 1) <> '9' and {s} not rlike '-00-|-0000$'",
    "account": "length(regexp_replace({s}, ' ', '')) between 15 and 34 and " + _MOD_97,
    "written_mail": "{s} rlike '(?i)[^a-z][a-z]{{2,10}}$' and {s} rlike '(?i)^[a-z0-9][^\\\\[(]*[a-z0-9]\\\\x20?[\\\\[(]'",
    "digits": _VALID["card"],
    "dotted": "size(split({s}, '[.]')) = 4 and " + _VALID["ip"],
    "plus": _VALID["phone"],
    "at": f"{{s}} rlike '^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+[.,;:!?]?$'",
}


def hits(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, hits) of rows (doc_id, tag, t): the matches of all patterns, in one pass over the texts."""
    guards = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9]", "phone": "[+][0-9]"}
    patterns = [(p, guards[k]) for k, p in BASE.items()] + [(p, g) for _, _, p, g in GENERATORS]
    return rows.select("doc_id", "tag", F.concat(*[_hits("t", n, p, g) for n, (p, g) in enumerate(patterns)]).alias("hits"))


def candidates(found: DataFrame) -> DataFrame:
    """(tag, pat, kind, rank, start, end, s, l, r) of the hits: base spans that hold, and all generated ones.

    ``pat`` below the number of base kinds marks a base span. Places are running sums of gaps and lengths.
    """
    w = Window.partitionBy("tag", "pat").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.select("tag", F.explode("hits").alias("h")).select("tag", "h.*").withColumn("end", F.sum(F.col("gap") + F.col("len")).over(w).cast("int"))
    kinds = [*BASE, *(k for _, k, _, _ in GENERATORS)]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("pat") + 1)
    rank = F.element_at(F.array(*[F.lit(KINDS.index(k)) for k in kinds]), F.col("pat") + 1)
    valid = F.lit(True)
    for n, k in enumerate(BASE):
        valid = F.when(F.col("pat") == n, F.expr(_VALID[k].format(s="s"))).otherwise(valid)
    return rows.where(valid).select("tag", "pat", kind.alias("kind"), rank.alias("rank"), (F.col("end") - F.col("len")).alias("start"), "end", "s", "l", "r")


def features(cands: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context features of candidate rows (s, l, r); what proposed a candidate is none of them."""
    n = F.greatest(F.length("s"), F.lit(1)).cast("double")
    count = lambda col, p: F.regexp_count(F.col(col), F.lit(p)).cast("double")
    found = {"f_len": n, "f_distinct": F.size(F.array_distinct(F.split("s", ""))) / n}
    found |= {f"f_{k}": count("s", p) for k, p in _CLASS.items()} | {f"f_share_{k}": count("s", p) / n for k, p in _CLASS.items()}
    found |= {"f_dot": count("s", "[.]"), "f_dash": count("s", "-"), "f_at": count("s", "@"), "f_first_digit": F.coalesce(F.regexp_extract("s", "([0-9])", 1).try_cast("double"), F.lit(-1.0))}
    found |= {f"f_left_{k}": F.right("l", F.lit(1)).rlike(p).cast("double") for k, p in _CLASS.items()} | {f"f_right_{k}": F.left("r", F.lit(1)).rlike(p).cast("double") for k, p in _CLASS.items()}
    found |= {"f_key_left": F.col("l").rlike(r"(?i)(phone|tel|call|mail|contact|card|account|ssn|ip|host|version|license)").cast("double"), "f_parts": F.size(F.split("s", "[^A-Za-z0-9]+")).cast("double")}
    found |= {f"f_max_part_{k}": F.expr("cast(array_max(transform(split(s, '[^A-Za-z0-9]+'), x -> length(x))) as double)") for k in ("len",)}
    return cands.withColumns(found), list(found)


def _confirmed() -> Column:
    out = F.lit(False)
    for g, (name, *_) in enumerate(GENERATORS):
        out = F.when(F.col("generator") == g, F.coalesce(F.expr(_CONFIRMS[name].format(s="s", l="l")), F.lit(False))).otherwise(out)
    return out


def select_spans(cands: DataFrame) -> DataFrame | None:
    """Candidate rows that the calibrated trees accept, with their probability p; None without two classes.

    Fitting and calibration rows come from two halves of the candidates, by hash, up to FIT_ROWS each.
    """
    rows, names = features(cands.withColumn("generator", F.col("pat") - len(BASE)))
    rows = rows.withColumn("label", _confirmed().cast("double")).withColumn("half", F.pmod(F.xxhash64("s", "l", "start"), F.lit(2)))
    n = rows.count()
    if not n:
        return None
    share = F.pmod(F.xxhash64("l", "s", "end"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, 2.0 * FIT_ROWS / n)))
    fit = VectorAssembler(inputCols=names, outputCol="vector").transform(rows.where(share & (F.col("half") == 0)).select("label", *names).limit(FIT_ROWS).coalesce(1))
    fit = written(fit.select("label", "vector"), "fit").coalesce(1)
    if fit.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(fit)
    assembled = VectorAssembler(inputCols=names, outputCol="vector").transform(rows).drop(*names)
    scored = model.transform(assembled).withColumn("p", F.round(vector_to_array("probability")[1], 3)).drop("vector", "rawPrediction", "probability", "prediction")
    scored = written(scored, "scored")
    bins = scored.where(F.col("half") == 1).groupBy("generator", "p").agg(F.sum("label").alias("hit"), F.count(F.lit(1)).alias("all"))
    # the lowest probability from which on a generator's precision is high enough; at most 1,001 rows each
    tail = bins.alias("a").join(bins.alias("b"), F.expr("a.generator = b.generator and b.p >= a.p")).groupBy("a.generator", "a.p").agg((F.sum("b.hit") / F.sum("b.all")).alias("precision"))
    threshold = tail.where(F.col("precision") >= PRECISION).groupBy("generator").agg(F.min("p").alias("least"))
    return scored.join(F.broadcast(threshold), "generator").where(F.col("p") >= F.greatest("least", F.lit(0.5)))


def _free(base: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``chosen`` that overlap no row of ``base``, both with tag, start and end."""
    both = base.select("tag", "start", "end", F.lit(True).alias("base"), F.lit(0.0).alias("cost"), "rank", "kind").unionByName(chosen.select("tag", "start", "end", F.lit(False).alias("base"), (-F.col("p")).alias("cost"), "rank", "kind"))
    own = F.when(F.col("base"), F.struct("start", "end"))
    up = Window.partitionBy("tag").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("tag").orderBy(F.desc("start"), "base").rowsBetween(Window.unboundedPreceding, -1)
    sides = both.withColumn("_before", F.max(own["end"]).over(up)).withColumn("_after", F.min(own["start"]).over(down))
    clear = (F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.coalesce("_after", F.col("end")) >= F.col("end"))
    return sides.where(~F.col("base") & clear).drop("_before", "_after", "base")


def _selected(free: DataFrame) -> DataFrame:
    """Of overlapping rows the most probable, by start and end where equal: decided within runs of overlapping spans."""
    w = Window.partitionBy("tag").orderBy("start", "end", "rank")
    latest = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = free.withColumn("_new", (latest.isNull() | (F.col("start") >= latest)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = runs.groupBy("tag", "_run").agg(F.array_sort(F.collect_list(F.struct("cost", "start", "end", "rank", "kind"))).alias("xs"))
    pick = f"""aggregate(xs, cast(array() as {_SPAN}), (a, x) -> if(exists(a, y -> y.start < x.end and x.start < y.end), a,
        concat(a, array(named_struct('start', x.start, 'rank', x.rank, 'end', x.end, 'kind', x.kind)))))"""
    return rows.select("tag", F.explode(F.expr(pick)).alias("x")).select("tag", "x.*")


def _spans(rows: DataFrame) -> DataFrame:
    """(tag, doc_id, base, spans) of every row (doc_id, tag, t)."""
    table = written(hits(rows), "pii")
    found = written(candidates(table), "candidates")
    base = found.where(F.col("pat") < len(BASE))
    chosen = select_spans(found.where(F.col("pat") >= len(BASE)))
    span = F.struct("start", "rank", "end", "kind")
    marked = base.select("tag", span.alias("x"), F.lit(True).alias("base"))
    if chosen is not None:
        marked = marked.unionByName(_selected(_free(base, chosen)).select("tag", span.alias("x"), F.lit(False).alias("base")))
    lists = marked.groupBy("tag").agg(F.array_sort(F.collect_list(F.when(F.col("base"), F.col("x")))).alias("base"), F.array_sort(F.collect_list("x")).alias("spans"))
    none = F.array().cast(_SPAN)
    out = table.select("tag", "doc_id").join(lists, "tag", "left")
    return out.select("tag", "doc_id", F.coalesce(F.col("base").cast(_SPAN), none).alias("base"), F.coalesce(F.col("spans").cast(_SPAN), none).alias("spans"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("tag"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and all spans: arrays of (start, rank of kind, end, kind), sorted."""
    return _spans(_rows(docs, id_col, text_col)).drop("tag")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with each selected span replaced by its kind in brackets; ids may be null or repeated."""
    rows = written(_rows(docs, id_col, text_col), "texts")
    # the pieces between spans, joined once: linear in the text
    pieces = """concat(
        transform(spans, (x, i) -> concat(substr(t, if(i = 0, 0, spans[i - 1].end) + 1, greatest(0, x.start - if(i = 0, 0, spans[i - 1].end))), '[', x.kind, ']')),
        array(substr(t, if(size(spans) = 0, 0, spans[size(spans) - 1].end) + 1)))"""
    # a base span of one kind may overlap one of another: the first stands for both, and covers them
    merged = f"""aggregate(spans, cast(array() as {_SPAN}), (a, x) -> if(size(a) > 0 and x.start < a[size(a) - 1].end,
        concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'rank', a[size(a) - 1].rank, 'end', greatest(a[size(a) - 1].end, x.end), 'kind', a[size(a) - 1].kind))),
        concat(a, array(x))))"""
    both = rows.join(_spans(rows).select("tag", "spans"), "tag")
    overlaps = "exists(transform(spans, (x, i) -> i > 0 and spans[i - 1].end > x.start), x -> x)"
    both = both.withColumn("spans", F.when(F.expr(overlaps), F.expr(merged)).otherwise(F.col("spans")))
    return both.select("doc_id", F.array_join(F.expr(pieces), "").alias("text"))
