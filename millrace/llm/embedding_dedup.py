"""Near-duplicate vectors by cross-polytope hashing with multiprobe and exact verification.

A vector is turned by three rounds of random signs and fast Hadamard transforms; the hash is the nearest
signed axis. Two such hashes name a bucket of one table; further buckets per table follow the axes that come
next. Equal vectors are joined to one class first; vectors that meet in a bucket are compared in double
precision. A pair is counted in the first bucket that it shares, so no table of pairs is needed: what leaves a
comparison is each vector's number of links and one row per vector that ties it to its component.

Defined results: a null label, or a vector that is null, empty, zero or has null or non-finite components,
links with nothing and is kept; vectors of different length are not compared; repeated rows count as vectors
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

THRESHOLD = 0.98
TABLES, HASHES, PROBES = 8, 2, 3
#: Members of a block; a bucket with more is compared block by block, in as many tasks as block pairs.
BLOCK = 512
#: Rows of small buckets that one task compares together.
GROUP = 4096
#: Parts into which the rows of a bucket are dealt to meet its size.
SALTS = 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """(rows x tables x (1 + probes)) bucket numbers; the first of a table is the vector's own bucket."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - d)))
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        axes, sizes = [], []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            top = np.argsort(-np.abs(y), 1, kind="stable")[:, : 1 + probes]
            val = np.take_along_axis(y, top, 1)
            axes.append(2 * top + (val < 0))
            sizes.append(np.abs(val))
        scale = 2 * width
        main = sum(a[:, 0] * scale**h for h, a in enumerate(axes))
        out[:, t, 0] = main
        # probing one hash's next axis costs the drop in size; the cheapest changes come first
        moves = [(h, k) for h in range(hashes) for k in range(1, axes[h].shape[1])]
        if not moves or not probes:
            out[:, t, 1:] = main[:, None]
            continue
        cost = np.stack([sizes[h][:, 0] ** 2 - sizes[h][:, k] ** 2 for h, k in moves], 1)
        to = np.stack([main + (axes[h][:, k] - axes[h][:, 0]) * scale**h for h, k in moves], 1)
        best = np.argsort(cost, 1, kind="stable")[:, :probes]
        found = to[rows[:, None], best]
        out[:, t, 1 : 1 + found.shape[1]] = found
        out[:, t, 1 + found.shape[1] :] = main[:, None]
    return out


def _valid(vector: str, label: str) -> F.Column:
    ok = F.expr(f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(cast({vector} as array<double>), x -> x <> 0)")
    return F.coalesce(F.col(label).isNotNull() & F.col(vector).isNotNull() & ok, F.lit(False))


def _codes_of(x: np.ndarray) -> np.ndarray:
    return codes(x / np.linalg.norm(x, axis=1, keepdims=True))


def candidate_buckets(classes: DataFrame) -> DataFrame:
    """(cls, label, tab, bucket) for each bucket that a class (cls, label, x) enters; tab holds the width and the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            xs = batch.column("x")
            sizes = np.asarray(xs.value_lengths())
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                found = _codes_of(np.asarray(xs.take(pa.array(at)).flatten(), float).reshape(len(at), d))
                for t in range(found.shape[1]):
                    rows = np.repeat(np.arange(len(at)), found.shape[2])
                    pick = np.unique(np.stack([rows, found[:, t].ravel()]), axis=1)
                    take = pa.array(at[pick[0]])
                    yield pa.RecordBatch.from_arrays([batch.column("cls").take(take), batch.column("label").take(take), pa.array(np.full(len(take), int(d) << 8 | t)), pa.array(pick[1])], names=["cls", "label", "tab", "bucket"])

    kind = dict(classes.dtypes)["label"]
    return classes.select("cls", "label", "x").mapInArrow(run, f"cls bigint, label {kind}, tab bigint, bucket bigint")


def _owned(x: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether no earlier table, and no smaller bucket of this one, holds both rows of each pair."""
    used, at = np.unique(np.r_[i, j], return_inverse=True)
    c = _codes_of(x[used])
    out = np.ones(len(i), bool)
    for lo in range(0, len(i), 1 << 14):  # bounds the work arrays
        hi = min(lo + (1 << 14), len(i))
        a, b = c[at[lo:hi]], c[at[len(i) + lo : len(i) + hi]]
        same = (a[:, : table + 1, :, None] == b[:, : table + 1, None, :]).any(3)
        here = np.where(same[:, table], a[:, table], np.iinfo(np.int64).max).min(1)
        out[lo:hi] = ~same[:, :table].any((1, 2)) & (here == bucket)
    return out


def _ties(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pdf = pdf.sort_values(["tab", "bucket", "label", "cls"], kind="stable")
        cls, block, weight = pdf["cls"].to_numpy(), pdf["block"].to_numpy(), pdf["weight"].to_numpy()
        same = (pdf[["tab", "bucket", "label"]].to_numpy()[1:] == pdf[["tab", "bucket", "label"]].to_numpy()[:-1]).all(1)
        cuts = np.r_[0, np.flatnonzero(~same) + 1, len(pdf)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo < 2:
                continue
            y = np.stack(pdf["x"].iloc[lo:hi].to_numpy()).astype(float)
            norm = np.sqrt((y * y).sum(1))
            x = y / norm[:, None]
            i, j = np.nonzero(np.triu(x @ x.T >= threshold - 1e-9, 1))
            # the rule itself, in double precision, from the vectors as they are
            ok = (y[i] * y[j]).sum(1) / (norm[i] * norm[j]) >= threshold
            b = block[lo:hi]
            ok &= (b.min() == b.max()) | (b[i] != b[j])  # a pair of one block is that block's own task's
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            own = _owned(y, i, j, int(pdf["tab"].iloc[lo]) & 255, int(pdf["bucket"].iloc[lo]))
            far = np.bincount(i[own], weight[lo:hi][j[own]], hi - lo) + np.bincount(j[own], weight[lo:hi][i[own]], hi - lo)
            low, c = _ties(hi - lo, i, j), cls[lo:hi]
            use = np.flatnonzero((low != np.arange(hi - lo)) | (far > 0))
            out.append((c[use], c[low[use]], far[use].astype(np.int64)))
        a, b, far = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))
        return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64), "far": far.astype(np.int64)})

    return run


def links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, far) of classes (cls, label, x, n): b is in a's component; far adds up, over a's rows, to the vectors linked with a."""
    rows = written(candidate_buckets(classes), "buckets")
    key = ["tab", "bucket", "label"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).where("k > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(sizes, [*key, "salt"]).withColumn("blocks", F.ceil(F.col("k") / BLOCK))
    groups = max(1, classes.count() * TABLES * (1 + PROBES) // GROUP)
    small = rows.where("blocks = 1").select(*key, "cls", F.lit(0).cast("long").alias("block"), F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64(*key), F.lit(groups))).alias("task"))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    large = rows.where("blocks > 1").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    large = large.select(*key, "cls", "block", F.concat_ws(":", F.lit("l"), "tab", "bucket", "label", F.least("block", "other"), F.greatest("block", "other")).alias("task"))
    # vectors join last, and only those that meet another
    full = small.unionByName(large).join(classes.select("cls", "x", F.col("n").alias("weight")), "cls")
    return full.groupBy("task").applyInPandas(_compare(threshold), "a bigint, b bigint, far bigint")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    rows = rows.withColumn("ok", _valid("v", "label"))
    classes = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("n"))
    # -0.0 and 0.0 are one key; a class of rows without any id has no name and links with nothing
    classes = written(classes.where("cls is not null").withColumn("x", F.col("v")), "classes")
    found = written(links(classes, threshold), "links")
    count = found.groupBy("a").agg(F.sum("far").alias("far")).withColumnRenamed("a", "cls")
    comp = components(found.where("a <> b")).withColumnRenamed("node", "cls")
    named = classes.select("label", "v", "cls", "n").join(count, "cls", "left").join(comp, "cls", "left")
    named = written(named.select("label", "v", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id"), F.lit(True).alias("ok")), "named")
    out = rows.join(named, ["label", "v", "ok"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
