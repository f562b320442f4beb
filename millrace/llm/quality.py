"""Quality classification by positive-unlabelled learning.

A linear model over binned text statistics minimises the non-negative unbiased risk of trusted positives
against unlabelled web text. Bins are quantiles of all learning rows. Weights start from a bounded sample and then go
down the risk of all positives and all unlabelled rows, a pass over their bins a step, until it stops falling.
The share of positives in unlabelled text is estimated from the scores of all learning rows (between 0.05 and
0.95), and a logistic curve fitted on labelled rows, at most FIT_ROWS, turns the model's output into a probability.

Defined results: a null text is the empty text and gets a score like any other; label rows with a null id
or label are ignored, a document labelled twice counts by its larger label; without positives or unlabelled
rows every score is 0.5. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written

#: Most rows of each class that the weights start from, and most labelled rows of the probability curve.
FIT_ROWS = 20_000
BINS, STEPS, RATE, DECAY = 12, 250, 0.05, 1e-4
#: Most steps over all rows; they end after PATIENCE steps without a risk that is lower by the share FALL.
FULL_STEPS, PATIENCE, FALL = 40, 4, 1e-3
_SYMBOLS = re.compile(r"[^\w\s]{3,}")
_SHOUT = re.compile(r"!{2,}")
_LAST = re.compile(r"[.!?]\s")
STATS = 26


def statistics(text: str) -> list[float]:
    """Shape, vocabulary and repetition of a whole text; all but the first five are shares."""
    n = len(text) or 1
    words = text.split()
    w = len(words) or 1
    low = [x.lower() for x in words]
    seen = Counter(low)
    kinds = len(seen)
    lines = [x for x in text.split("\n") if x.strip()]
    m = len(lines) or 1
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    spaces = sum(map(str.isspace, text))
    data = text.encode("utf-8", "replace")
    packed = len(zlib.compress(data, 1)) / (len(data) or 1)
    same_next = sum(map(str.__eq__, low, low[1:]))
    top = max(seen.values(), default=0)
    return [
        np.log1p(n), np.log1p(w), np.log1p(len(lines)), n / w, n / m,
        letters / n, upper / n, digits / n, spaces / n, (n - letters - digits - spaces) / n,
        text.count("|") / w, text.count("!") / w, len(_SYMBOLS.findall(text)) / w, len(_SHOUT.findall(text)) / w, text.count(",") / w, len(_LAST.findall(text)) / w,
        kinds / w, top / w, same_next / w, 1 - len(set(lines)) / m, packed, sum(map(str.isupper, words)) / w, sum(map(str.isalpha, words)) / w, sum(len(x) <= 3 for x in words) / w, sum(len(x) > 15 for x in words) / w,
        sum(x[-1] in ".,;:" for x in words) / w,
    ]


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and x, the statistics of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = pa.array([statistics(t.as_py() or "") for t in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], xs], names=[*keep, "x"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", x array<double>")


class Model:
    """f(x) = sum over statistics of the weight of the bin that x falls in; score = logistic(a f + b)."""

    def __init__(self, edges: np.ndarray):
        self.edges, self.w, self.a, self.b = edges, np.zeros((len(edges), edges.shape[1] + 1)), 1.0, 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v, "right") for e, v in zip(self.edges, x.T, strict=True)], 1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.w[np.arange(bins.shape[1]), bins].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.a * self.margin(self.bins(x)) + self.b)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Descent:
    """Adam on the non-negative unbiased risk with the logistic loss: prior R+(P) + max(0, R-(U) - prior R-(P)).

    Where the second term goes negative a step reverses it instead of following the first.
    """

    def __init__(self, model: Model, prior: float, rate: float = RATE):
        self.model, self.prior, self.rate, self.t = model, prior, rate, 0
        self.first, self.second = np.zeros_like(model.w), np.zeros_like(model.w)

    def risk(self, p: Sums, u: Sums) -> float:
        """What the steps go down, the decay of the weights included."""
        return self.prior * p.risk_positive(self.model) + max(0.0, u.risk_negative - self.prior * p.risk_negative) + 0.5 * DECAY * float((self.model.w**2).sum())

    def step(self, p: Sums, u: Sums) -> None:
        negative = u.risk_negative - self.prior * p.risk_negative
        g_neg = u.grad_negative - self.prior * p.grad_negative
        g = (self.prior * p.grad_positive + g_neg if negative >= 0 else -g_neg) + DECAY * self.model.w
        self.t += 1
        self.first, self.second = 0.9 * self.first + 0.1 * g, 0.999 * self.second + 0.001 * g * g
        self.model.w -= self.rate * (self.first / (1 - 0.9**self.t)) / (np.sqrt(self.second / (1 - 0.999**self.t)) + 1e-8)


class Sums:
    """Means over rows of a class: the risk if they were negative, and the gradients as negatives and as positives."""

    def __init__(self, flat: np.ndarray, shape: tuple[int, int]):
        n = max(flat[0], 1.0)
        self.risk_negative = flat[1] / n
        self.grad_negative, self.grad_positive = (flat[2:] / n).reshape(2, *shape)

    def risk_positive(self, model: Model) -> float:
        """The risk if they were positive: of the logistic loss, the two differ by the mean margin."""
        return self.risk_negative - float((model.w * (self.grad_negative - self.grad_positive)).sum())

    @staticmethod
    def of(model: Model, bins: np.ndarray) -> np.ndarray:
        """Rows, risk and both gradients, summed: they add up over parts."""
        cols, width = np.arange(bins.shape[1]), model.w.shape[1]
        z = _logistic(model.margin(bins))
        spread = lambda g: np.bincount((bins + cols * width).ravel(), np.repeat(g, len(cols)), model.w.size)
        return np.concatenate([[len(bins), -np.log1p(-z + 1e-12).sum()], spread(z), spread(z - 1)])


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, edges: np.ndarray | None = None) -> Model:
    """The model after so many steps on these rows alone."""
    edges = np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if edges is None else edges
    model = Model(edges)
    bp, bu = model.bins(positive), model.bins(unlabelled)
    down = Descent(model, prior)
    for _ in range(steps):
        down.step(*(Sums(Sums.of(model, b), model.w.shape) for b in (bp, bu)))
    return model


def quantiles(rows: DataFrame) -> np.ndarray:
    """Inner bin edges of each statistic (STATS x BINS - 1) over all rows with a column x."""
    at = F.array(*[F.lit(float(q)) for q in np.linspace(0, 1, BINS + 1)[1:-1]])
    found = rows.agg(*[F.percentile_approx(F.col("x")[k], at, 10_000).alias(f"q{k}") for k in range(STATS)]).first()
    return np.array([found[k] for k in range(STATS)], float)


def binned(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """(positive, bins): the bin numbers of each row (x, quality), a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Model(edges).bins(np.array(batch.column("x").flatten()).reshape(-1, STATS)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array([b.tobytes() for b in found], pa.binary())], names=["positive", "bins"])

    return rows.select(F.col("quality").isNotNull().alias("positive"), "x").mapInArrow(run, "positive boolean, bins binary")


def full_sums(table: DataFrame, model: Model) -> tuple[Sums, Sums]:
    """Sums over all positive and all unlabelled rows of :func:`binned`: partial sums per task, added up by one aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2 + 2 * model.w.size))
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, STATS).astype(np.int64)
            side = np.array(batch.column("positive"), bool)
            for k in (0, 1):
                total[k] += Sums.of(model, bins[side == bool(k)])
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total[k]), k, np.int32)), pa.array(np.arange(len(total[k]), dtype=np.int32)), pa.array(total[k])], names=["side", "at", "v"])

    out = np.zeros((2, 2 + 2 * model.w.size))
    for r in table.mapInArrow(run, "side int, at int, v double").groupBy("side", "at").agg(F.sum("v").alias("v")).collect():  # two rows a weight
        out[r["side"], r["at"]] = r["v"]
    return Sums(out[1], model.w.shape), Sums(out[0], model.w.shape)


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """Up to FIT_ROWS of n rows, by a hash of the id, so the same on every run."""
    limit = FIT_ROWS
    share = F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, limit / max(n, 1))) + 1)
    found = rows.where(share).select("x").limit(limit).toPandas()["x"]
    return np.array(found.tolist(), float).reshape(-1, STATS)


def estimate_prior(p_bins: np.ndarray, u_bins: np.ndarray) -> float:
    """Share of positives in unlabelled text: the least ratio of the two score tails, over tails with enough rows."""
    p, u = np.cumsum(p_bins[::-1]), np.cumsum(u_bins[::-1])
    enough = (p >= max(20, 0.05 * p[-1])) & (u > 0)
    if not enough.any():
        return 0.5
    return float(np.clip(np.min((u / u[-1])[enough] / (p / p[-1])[enough]), 0.05, 0.95))


def fit_platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin, by Newton's method with a small ridge."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.zeros(2)
    for _ in range(30):
        p = _logistic(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - label) + 1e-3 * w)
    return float(w[0]), float(w[1])


def train(feats: DataFrame, labels: DataFrame) -> Model | None:
    """``feats`` (doc_id, x) of the learning fold, a written table; ``labels`` (doc_id, quality)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = written(feats.join(known, "doc_id", "left"), "learn")
    positive, unlabelled, labelled = rows.where("quality = 1"), rows.where("quality is null"), rows.where("quality is not null")
    counts = rows.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality").isNull()), F.count("quality")).first()
    if not counts[0] or not counts[1]:
        return None
    p, u = _sample(positive, counts[0]), _sample(unlabelled, counts[1])
    if not len(p) or not len(u):
        return None
    learning = rows.where("quality is null or quality = 1")
    edges = quantiles(learning)
    table = written(binned(learning, edges), "bins")
    first = fit_risk(p, u, 0.5, STEPS // 2, edges)
    settle(first, 0.5, table)
    hist = {q: np.zeros(200) for q in (0, 1)}
    scored = apply(learning, first, ("quality",))
    for r in scored.groupBy(F.coalesce("quality", F.lit(0)).alias("q"), F.least(F.floor(F.col("score") * 200), F.lit(199)).alias("k")).count().collect():  # 400 rows at most
        hist[r["q"]][r["k"]] = r["count"]
    prior = estimate_prior(hist[1], hist[0])
    model = fit_risk(p, u, prior, STEPS, edges)
    settle(model, prior, table)
    remove(table)
    marks = labelled.where(F.pmod(F.xxhash64(F.lit("curve"), F.col("doc_id")), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, FIT_ROWS / counts[2])) + 1)).select("x", "quality").limit(FIT_ROWS).toPandas()
    model.a, model.b = fit_platt(model.margin(model.bins(np.array(marks["x"].tolist(), float).reshape(-1, STATS))), marks["quality"].to_numpy(float))
    remove(rows)
    return model


def settle(model: Model, prior: float, table: DataFrame) -> int:
    """Go down the risk of all rows of :func:`binned` until it stops falling; returns the number of passes."""
    down, best, kept, since, passes = Descent(model, prior, RATE / 2), np.inf, model.w.copy(), 0, 0
    while passes < FULL_STEPS and since < PATIENCE:
        sums = full_sums(table, model)
        risk, passes = down.risk(*sums), passes + 1
        since = 0 if risk < best * (1 - FALL) else since + 1
        if risk < best:
            best, kept = risk, model.w.copy()
        down.step(*sums)
    model.w = kept
    return passes


def apply(feats: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and score."""
    if model is None:
        return feats.select(*keep, F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").flatten()).reshape(-1, STATS)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(model.score(x))], names=[*keep, "score"])

    kinds = dict(feats.dtypes)
    return feats.select(*keep, "x").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double")
