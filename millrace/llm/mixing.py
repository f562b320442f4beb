"""Mixing sources to target weights by iterative proportional fitting.

A document's topic is learnt from its words: signed hashes of its word counts, less the mean of its language (a
language is a margin of its own), are clustered by k-means over all documents. Token counts are summed over
(source, language, topic) cells; raking scales the cells until their margins meet the targets; where a cell
would be drawn with a probability above 1 it is raked on under that cap, until the expected draws meet the
targets that are feasible; each document is then drawn with its cell's calibrated probability, by a hash of its
id, so that the draw is the same on every run and in every partition. :func:`margins` tells what was asked for,
what is feasible and what is expected.

Defined results: nulls in source, language or topic form a cell value of their own; a null text has no
tokens, and a text without a word no topic; a cell without tokens keeps its documents; targets naming an absent
value are spread over the present ones; an empty table gives an empty result. Repeated rows are drawn alike. A
word of a script without spaces is a character. Further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import remove, row_of, written
from .hashing import words

DIMS = ("source", "lang", "topic")
NONE = "\u0000none"
#: Topics, numbers of a document's vector, and steps of k-means.
TOPICS, WIDTH, STEPS = 6, 64, 10


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and its vector: signed sums of 1 + log count over hashed words, of unit length."""
    n = len(texts)
    tokens, out = np.zeros(n), np.zeros((n, WIDTH))
    for lo, rows, row, h in words(texts):
        tokens[lo : lo + rows] = np.bincount(row, minlength=rows)
        order = np.lexsort((h, row))
        r, x = row[order], h[order]
        at = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])]) if len(r) else np.zeros(0, np.int64)
        count = np.diff(np.r_[at, len(r)])
        r, x = r[at], x[at]
        cell = r * WIDTH + (x % np.uint64(WIDTH)).astype(np.int64)
        out[lo : lo + rows] = np.bincount(cell, np.where(x >> np.uint64(63), 1.0, -1.0) * (1 + np.log(count)), rows * WIDTH).reshape(rows, WIDTH)
    return tokens, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _cell(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NONE))


class Topics:
    """Centres of the clusters, and (lang, shift): what a language's mean adds to the distance from each centre.

    A row's topic is the centre nearest to its vector less its language's mean. Of |x - m - c|^2 only
    |c|^2 - 2 x c + 2 m c differs between centres, so of a mean only its products with the centres are needed.
    """

    def __init__(self, centres: np.ndarray, shifts: DataFrame | None):
        self.centres, self.shifts = centres, shifts


def nearest(centres: np.ndarray, shifts: list[list[float] | None], tokens: np.ndarray, x: np.ndarray) -> list[str]:
    """The topic of each row; a text without a word has none."""
    if not len(centres):
        return [NONE if not n else "topic0" for n in tokens]
    moved = np.array([m or [0.0] * len(centres) for m in shifts]).reshape(len(x), len(centres))
    near = ((centres**2).sum(1) - 2 * x @ centres.T + 2 * moved).argmin(1)
    return [f"topic{t}" if n else NONE for t, n in zip(near, tokens, strict=True)]


#: Most languages whose few numbers are sent to every task; more are met by a shuffle.
SENT_LANGS = 20_000


def _by_language(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table`` (_lang, ...), one row a language."""
    few = table.limit(SENT_LANGS + 1).count() <= SENT_LANGS
    return rows.join(F.broadcast(table) if few else table, "_lang", "left")


def learn_topics(docs: DataFrame) -> Topics:
    """k-means over all documents with a word, each less the mean of its language, however many languages there are."""
    from pyspark.ml.clustering import KMeans  # here, so that Python workers, which import this module, don't load it
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, x = vectors(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("_lang"), pa.array(tokens), pa.array(list(x), pa.list_(pa.float64()))], names=["_lang", "tokens", "x"])

    table = written(docs.select("text", _cell("lang").alias("_lang")).mapInArrow(run, "_lang string, tokens double, x array<double>"), "vectors")
    rows = table.where("tokens > 0").select("_lang", "x")
    means = written(rows.groupBy("_lang").agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("m")), "means")
    if means.isEmpty():
        remove(table)
        remove(means)
        return Topics(np.zeros((0, WIDTH)), None)
    centred = _by_language(rows, means).select(array_to_vector(F.zip_with("x", "m", lambda a, b: a - b)).alias("features"))
    found = KMeans(k=TOPICS, maxIter=STEPS, seed=5).fit(centred)
    centres = np.array(found.clusterCenters())
    product = lambda c: F.aggregate(F.zip_with("m", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    shifts = written(means.select("_lang", F.array(*[product(c) for c in centres]).alias("_shift")), "shifts")
    remove(table)
    remove(means)
    return Topics(centres, shifts)


def cell_rows(docs: DataFrame, topics: Topics | None = None) -> DataFrame:
    """(row, _source, _lang, _tokens, _topic): the rows as structs, so that no name clashes."""
    topics = topics or learn_topics(docs)
    known = docs.select(row_of(docs), _cell("source").alias("_source"), _cell("lang").alias("_lang"))
    schema, at = known.schema, docs.columns.index("text")
    known = _by_language(known, topics.shifts) if topics.shifts is not None else known.withColumn("_shift", F.lit(None).cast("array<double>"))
    known = known.select("row", "_source", "_lang", "_shift")
    centres = docs.sparkSession.sparkContext.broadcast(topics.centres)  # TOPICS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, x = vectors(batch.column("row").field(at))
            topic = nearest(centres.value, batch.column("_shift").to_pylist(), tokens, x)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("_source"), batch.column("_lang"), pa.array(tokens), pa.array(topic, pa.string())], names=["row", "_source", "_lang", "_tokens", "_topic"])

    return known.mapInArrow(run, StructType([*schema.fields, StructField("_tokens", DoubleType()), StructField("_topic", StringType())]))


def with_cells(docs: DataFrame, topics: Topics | None = None) -> DataFrame:
    """:func:`cell_rows` with the columns of ``docs`` beside the new ones, which replace columns of the same name."""
    return _flat(cell_rows(docs, topics), docs.columns)


def _flat(out: DataFrame, columns: list[str]) -> DataFrame:
    new = [c for c in out.columns if c != "row"]
    return out.select(*[F.col(f"row.`{c}`") for c in columns if c not in new], *new)


def tempered_targets(cells: DataFrame, dim: str, temperature: float) -> DataFrame:
    """(value, target): shares proportional to tokens to the power ``temperature``."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(temperature)).alias("w"))
    return sums.join(F.broadcast(sums.agg(F.sum("w").alias("all"))), F.lit(True)).select(dim, (F.col("w") / F.col("all")).alias("target"))


#: Raking ends when every margin is within TOLERANCE of its target, in shares, and after SWEEPS sweeps at the latest.
TOLERANCE, SWEEPS, PER_TABLE = 5e-5, 40, 8


def _off(fit: DataFrame, weight: Column, to: dict[str, Column]) -> float:
    """Largest distance of a margin from its target, in shares of the whole: one job for all dimensions."""
    parts = F.array(*[F.struct(F.lit(dim).alias("d"), F.col(dim).alias("v"), weight.alias("w"), target.alias("t")) for dim, target in to.items()])
    sums = fit.select(F.explode(parts).alias("x")).select("x.*").groupBy("d", "v").agg(F.sum("w").alias("w"), F.max("t").alias("t"))
    far, total = sums.agg(F.max(F.abs(F.col("w") - F.col("t"))), F.sum("w")).first()
    return far * len(to) / total if total else 0.0


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, per_table: int = PER_TABLE) -> DataFrame:
    """Scale ``tokens`` of the cells to ``w`` until every margin meets its target (shares that sum to 1).

    ``cells`` has one row for each value combination that occurs, so its size follows the categories and
    never the documents. A margin is a window sum, which refers to the fit so far once: joining margins
    back would name it twice a step and let the plan grow exponentially. The lineage is cut every
    ``per_table`` sweeps.
    """
    fit = cells.withColumn("w", F.col("tokens"))
    for dim, target in targets.items():
        present = cells.where("tokens > 0").select(dim).distinct().join(target, dim)
        share = present.join(F.broadcast(present.agg(F.sum("target").alias("_t"))), F.lit(True)).select(dim, (F.col("target") / F.col("_t")).alias(f"_to_{dim}"))
        fit = fit.join(share, dim, "left").fillna(0.0, [f"_to_{dim}"])
    for n in range(sweeps):
        for dim in targets:
            margin = F.sum("w").over(Window.partitionBy(dim))
            fit = fit.withColumn("w", F.when(margin > 0, F.col("w") * F.col(f"_to_{dim}") / margin).otherwise(0.0))
        if n % per_table == per_table - 1 or n == sweeps - 1:
            fit = written(fit, "rake")
            if _off(fit, F.col("w"), {d: F.col(f"_to_{d}") for d in targets}) < TOLERANCE:
                break
    return fit


def calibrate(fit: DataFrame, keep_share: float) -> DataFrame:
    """Adds p = min(1, c x weight / tokens) with c such that ``keep_share`` of all tokens are expected.

    c is found by two passes over a grid of 64 values each; only one row of sums reaches the driver.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)
    fit = fit.withColumn("f", ratio)
    total, top, low = fit.agg(F.sum("tokens"), F.max("f"), F.min(F.when(F.col("f") > 0, F.col("f")))).first()
    if not total or not top:
        return fit.withColumn("p", F.lit(1.0))
    want = keep_share * total
    lo, hi = 0.0, 1.0 / low  # at hi every cell with weight is taken whole
    for _ in range(4):
        grid = [lo + (hi - lo) * k / 64 for k in range(65)]
        sums = fit.agg(*[F.sum(F.least(F.lit(1.0), F.lit(c) * F.col("f")) * F.col("tokens")).alias(f"s{k}") for k, c in enumerate(grid)]).first()
        k = next((k for k in range(65) if sums[k] >= want), 64)
        lo, hi = grid[max(0, k - 1)], grid[k]
    return fit.withColumn("p", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(hi) * F.col("f"))).otherwise(1.0))


def _level(table: DataFrame, cap: str, rate: str, want: float) -> float:
    """s with the sum of min(cap, s x rate) being ``want``, or, where all caps are less, one that reaches every cap."""
    lo, hi = 0.0, table.agg(F.max(F.when(F.col(rate) > 0, F.col(cap) / F.col(rate)))).first()[0] or 0.0
    for _ in range(6):
        grid = [lo + (hi - lo) * k / 64 for k in range(65)]
        sums = table.agg(*[F.sum(F.least(F.col(cap), F.lit(c) * F.col(rate))).alias(f"s{k}") for k, c in enumerate(grid)]).first()
        k = next((k for k in range(65) if (sums[k] or 0.0) >= want), 64)
        lo, hi = grid[max(0, k - 1)], grid[k]
    return hi


def capped(fit: DataFrame, dims: list[str], keep_share: float, sweeps: int = SWEEPS, per_table: int = PER_TABLE) -> DataFrame:
    """Rake on where p is cut off at 1, until the expected draws, not the weights, meet the feasible targets.

    A value's target (column _at_<dim>, in tokens) is its share of what is kept; where that exceeds its tokens
    it is taken whole, and the others share what is left by their targets. Cells keep their uncut weight, and
    the margins that scale it are of what can be drawn.
    """
    total, cut = fit.agg(F.sum("tokens"), F.count_if((F.col("tokens") > 0) & (F.col("p") >= 1))).first()
    if not total or not cut:
        return fit
    for dim in dims:
        sums = written(fit.where("tokens > 0").groupBy(dim).agg(F.sum("tokens").alias("cap"), F.max(f"_to_{dim}").alias("rate")), f"caps-{dim}")
        s = _level(sums, "cap", "rate", keep_share * total)
        fit = fit.join(sums.select(dim, F.least("cap", F.lit(s) * F.col("rate")).alias(f"_at_{dim}")), dim, "left").fillna(0.0, [f"_at_{dim}"])
    fit = fit.withColumn("g", F.lit(keep_share) * F.lit(total) * F.col("w"))
    for n in range(sweeps):
        for dim in dims:
            margin = F.sum(F.least("tokens", "g")).over(Window.partitionBy(dim))
            fit = fit.withColumn("g", F.when(margin > 0, F.col("g") * F.col(f"_at_{dim}") / margin).otherwise(0.0))
        if n % per_table == per_table - 1 or n == sweeps - 1:
            fit = written(fit, "capped")
            if _off(fit, F.least("tokens", "g"), {d: F.col(f"_at_{d}") for d in dims}) < TOLERANCE:
                break
    return fit.withColumn("p", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("g") / F.col("tokens"))).otherwise(1.0))


def margins(fit: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, value, target, feasible, expected): token shares asked for, feasible under the caps, and expected of the draw."""
    kept = F.sum(F.col("p") * F.col("tokens"))
    out = None
    for dim in dims:
        at = F.max(f"_at_{dim}") if f"_at_{dim}" in fit.columns else F.lit(None).cast("double")
        rows = fit.where("tokens > 0").groupBy(F.col(dim).alias("value")).agg(F.max(f"_to_{dim}").alias("target"), at.alias("at"), kept.alias("kept"))
        sums = rows.agg(F.sum("kept").alias("_k"), F.sum("at").alias("_a"))
        rows = rows.join(F.broadcast(sums), F.lit(True)).select(F.lit(dim).alias("dim"), "value", "target", F.coalesce(F.col("at") / F.col("_a"), "target").alias("feasible"), (F.col("kept") / F.col("_k")).alias("expected"))
        out = rows if out is None else out.unionByName(rows)
    return out


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(1 << 53)) / F.lit(float(1 << 53))


#: Most cells that are fitted in memory; their number follows the categories, never the documents.
FEW_CELLS = 20_000


def _fitted_in_memory(cells: DataFrame, targets: dict[str, DataFrame], keep_share: float, sweeps: int) -> DataFrame:
    """The steps of :func:`rake`, :func:`calibrate` and :func:`capped` over arrays of at most FEW_CELLS cells."""
    fit, dims = cells.toPandas(), list(targets)
    tokens = fit["tokens"].to_numpy(float)
    code, size, to = {}, {}, {}
    for d in dims:
        names, code[d] = np.unique(fit[d].to_numpy(dtype=object).astype(str), return_inverse=True)
        size[d] = len(names)
        wanted = {r[d]: r["target"] for r in targets[d].join(cells.select(d).distinct(), d).collect()}
        share = np.array([wanted.get(x, 0.0) for x in names]) * (np.bincount(code[d], tokens > 0, size[d]) > 0)
        to[d] = share / share.sum() if share.sum() else share
        fit[f"_to_{d}"] = to[d][code[d]]

    def swept(w: np.ndarray, goal: dict[str, np.ndarray], cap: np.ndarray | None) -> np.ndarray:
        for n in range(sweeps):
            for d in dims:
                margin = np.bincount(code[d], w if cap is None else np.minimum(cap, w), size[d])[code[d]]
                w = np.where(margin > 0, w * goal[d][code[d]] / np.where(margin > 0, margin, 1), 0.0)
            drawn = w if cap is None else np.minimum(cap, w)
            off = max((np.abs(np.bincount(code[d], drawn, size[d]) - goal[d]).max(initial=0.0) for d in dims), default=0.0)
            if off < TOLERANCE * (drawn.sum() or 1.0):
                break
        return w

    fit["w"] = swept(tokens.copy(), to, None)
    f = np.divide(fit["w"].to_numpy(), tokens, out=np.zeros(len(fit)), where=tokens > 0)
    total, p = tokens.sum(), np.ones(len(fit))
    if total and f.max() > 0:
        lo, hi = 0.0, 1.0 / f[f > 0].min()
        for _ in range(4):
            grid = np.linspace(lo, hi, 65)
            k = next((k for k, c in enumerate(grid) if (np.minimum(1.0, c * f) * tokens).sum() >= keep_share * total), 64)
            lo, hi = grid[max(0, k - 1)], grid[k]
        p = np.where(tokens > 0, np.minimum(1.0, hi * f), 1.0)
        if ((tokens > 0) & (p >= 1)).any():
            goal = {}
            for d in dims:
                cap = np.bincount(code[d], tokens, size[d])
                lo, hi = 0.0, max((c / r for c, r in zip(cap, to[d]) if r > 0), default=0.0)
                for _ in range(6):
                    grid = np.linspace(lo, hi, 65)
                    k = next((k for k, c in enumerate(grid) if np.minimum(cap, c * to[d]).sum() >= keep_share * total), 64)
                    lo, hi = grid[max(0, k - 1)], grid[k]
                goal[d] = np.minimum(cap, hi * to[d])
                fit[f"_at_{d}"] = goal[d][code[d]]
            g = swept(keep_share * total * fit["w"].to_numpy(), goal, tokens)
            p = np.where(tokens > 0, np.minimum(1.0, np.divide(g, tokens, out=np.zeros(len(g)), where=tokens > 0)), 1.0)
    fit["p"] = p
    kinds = dict(cells.dtypes) | {c: "double" for c in fit.columns if c not in cells.columns}
    return cells.sparkSession.createDataFrame(fit, ", ".join(f"`{c}` {kinds[c]}" for c in fit.columns))


def fitted(cells: DataFrame, targets: dict[str, DataFrame], keep_share: float, sweeps: int = SWEEPS, few: int = FEW_CELLS) -> DataFrame:
    """The cells with p, as a written table: fitted in memory if they are few, else by window sums over tables.

    Both ways take the same steps; where few sweeps are enough the tables take some more, as they are tested less often.
    """
    if cells.limit(few + 1).count() <= few:
        return written(_fitted_in_memory(cells, targets, keep_share, sweeps), "fitted")
    return written(capped(written(calibrate(rake(cells, targets, sweeps), keep_share), "calibrated"), list(targets), keep_share, sweeps), "fitted")


def cells_of(rows: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens, n_docs) of the cells that occur, as a written table."""
    return written(rows.groupBy(*[F.col(f"_{d}").alias(d) for d in DIMS]).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "cells")


def mix_rows(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = 0.7, keep_share: float = 0.8, sweeps: int = SWEEPS) -> DataFrame:
    """(row, _tokens, _source, _lang, _topic, _p, _drawn): every row of ``docs`` as a struct, its probability, and whether it is drawn.

    ``targets`` maps a dimension to (dimension, target) rows; by default each margin is tempered, which
    lowers the largest sources and lifts the small ones.
    """
    rows = cell_rows(docs)
    cells = cells_of(rows)
    if targets is None:
        targets = {d: written(tempered_targets(cells, d, temperature), f"target-{d}") for d in DIMS}
    fit = fitted(cells, targets, keep_share, sweeps)
    prob = fit.select(*[F.col(d).alias(f"_{d}") for d in DIMS], F.col("p").alias("_p"))
    return rows.join(prob, [f"_{d}" for d in DIMS], "left").withColumn("_p", F.coalesce("_p", F.lit(1.0))).withColumn("_drawn", uniform(F.col("row.doc_id")) < F.col("_p"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = 0.7, keep_share: float = 0.8, sweeps: int = SWEEPS) -> DataFrame:
    """:func:`mix_rows` with the columns of ``docs`` beside the new ones, which replace columns of the same name."""
    return _flat(mix_rows(docs, targets, temperature, keep_share, sweeps), docs.columns)
