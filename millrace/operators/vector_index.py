"""A stored vector index: coarse cells with residual codes, searched by cell, merged, and re-ranked exactly.

``build`` cuts the unit vectors into cells around centres and keeps, for each vector, four bits a dimension of what is
left after its cell's centre, rotated. Blocks of a cell's codes are rows of a table; whole vectors lie in another one. Cells are dealt to
shares, a large cell to several. A search takes a whole set of queries: each goes once to every share that holds a cell it looks into,
where a share's codes are held and its queries stream by; each query's best estimates go on, are joined with their
vectors and ranked by the exact cosine. So whole vectors are compared for
``rerank`` x k items of a query, whatever the size of the index.

Centres, code ranges and the number of cells to look into come from a sample of at most SAMPLE vectors, chosen by a
hash of the key; of these, at most PROBE_QUERIES calibrate the number of cells, the smallest that holds ``recall`` of their true
neighbours. Every vector is indexed, and ``add`` appends further ones under the same centres. Where vectors have no clusters at all,
many cells are needed, and the codes, an eighth of a vector of floats, do the work.

Defined results: items whose vector is null, empty, of another width than the first sampled one or holds null or
non-finite numbers are not indexed, and such queries find nothing; a zero vector is 0 to all; ties go by key; repeated
keys are items of their own. An index of no items finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import written
from .retrieval import runs_of

SAMPLE, MAX_CELLS, PROBE_QUERIES = 32_768, 4096, 512
#: Codes of a stored block, queries of a step, pairs of a step, shares of the cells, stored shards.
BLOCK, QUERY_BLOCK, PAIRS, SHARES, SHARDS = 2048, 256, 1 << 21, 64, 64


@dataclass(frozen=True)
class Model:
    """What was fitted: rows of ``centres``, the rotation, and the range of each rotated dimension's codes."""

    centres: np.ndarray
    turn: np.ndarray
    low: np.ndarray
    step: np.ndarray
    probes: int
    spread: np.ndarray  # how many shares each cell is dealt to

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each row."""
        return np.argmax(x @ self.centres.T - 0.5 * (self.centres**2).sum(1), 1) if len(x) else np.zeros(0, np.int64)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The cells that each query looks into, nearest first."""
        return np.argsort(-(q @ self.centres.T - 0.5 * (self.centres**2).sum(1)), 1, kind="stable")[:, : self.probes]

    def encode(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        r = (x - self.centres[cells]) @ self.turn
        code = np.clip(np.rint((r - self.low) / self.step), 0, 15).astype(np.uint8)
        code = np.pad(code, ((0, 0), (0, code.shape[1] % 2)))
        return code[:, ::2] << 4 | code[:, 1::2]

    def decode(self, cells: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The coded vectors y, and (1 - |y|^2) / 2."""
        code = np.stack([codes >> 4, codes & 15], 2).reshape(len(codes), -1)[:, : self.width]
        y = (self.centres @ self.turn + self.low)[cells] + code * self.step
        return y.astype(np.float32), ((1 - (y * y).sum(1)) / 2).astype(np.float32)

    def estimate(self, q: np.ndarray, y: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Estimated cosine of each query and each coded vector y: 1 - |q - y|^2 / 2.

        Distances, as the error of q y grows with q, that of |q - y| with the distance: near items are told apart.
        """
        return (q @ self.turn).astype(np.float32) @ y.T + rest

    def shares(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``cells``, share): all shares of each cell."""
        n = self.spread[cells]
        at = np.repeat(np.arange(len(cells)), n)
        return at, (cells[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)) % SHARES


def _usable(vector: Column, width: int) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == width) & whole


def _units(items: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(k, v, u): key, vector, vector of length one."""
    v = F.col(f"`{vector}`")
    return items.where(_usable(v, width)).select(F.col(f"`{key}`").alias("k"), v.alias("v"), V.l2_normalised(v).alias("u"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def fit(items: DataFrame, key: str, vector: str, recall: float = 0.97, cells: int | None = None) -> Model | None:
    """The model of a sample; None if no item has a vector."""
    v = F.col(f"`{vector}`")
    first = items.where(v.isNotNull() & (F.size(v) > 0)).select(F.size(v).alias("n")).groupBy().agg(F.mode("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if not first["rows"]:
        return None
    units = _units(items, key, vector, first["n"]).select("k", "u")
    hashed, sample = F.xxhash64("k"), None
    if first["rows"] > 2 * SAMPLE:  # the least hashes, of which nearly all rows have none: else each task would hand on a whole sample
        sample = written(units.where(hashed < int(-(2.0**63) + 2.0**64 * 1.2 * SAMPLE / first["rows"])).orderBy(hashed, "k").limit(SAMPLE), "sample")
    if sample is None or sample.count() < SAMPLE // 2:  # few rows, or keys that recur
        sample = written(units.orderBy(hashed, "k").limit(SAMPLE), "sample")
    sample = sample.orderBy(hashed, "k").select("u", array_to_vector("u").alias("x"))
    few = np.array([r["u"] for r in sample.select("u").limit(2048).collect()], float).reshape(-1, first["n"])
    if not len(few):
        return None
    cells = cells or int(min(MAX_CELLS, max(1, round(first["rows"] ** 0.5)), max(1, SAMPLE // 16)))
    kept = KMeans(k=cells, featuresCol="x", seed=11, maxIter=8).fit(sample) if cells > 1 else None
    centres = np.array(kept.clusterCenters(), float) if kept else few.mean(0, keepdims=True)
    turn = np.linalg.qr(np.random.default_rng(11).standard_normal((first["n"],) * 2))[0]
    model = Model(centres, turn, np.zeros(first["n"]), np.ones(first["n"]), len(centres), np.ones(len(centres), np.int64))
    part = np.bincount(model.cells(few), minlength=len(centres)) / len(few)
    spread = np.clip(np.ceil(SHARES * part), 1, SHARES).astype(np.int64)
    left = (few - centres[model.cells(few)]) @ turn
    low, high = np.quantile(left, 0.002, 0), np.quantile(left, 0.998, 0)
    model = Model(centres, turn, low, np.maximum((high - low) / 15, 1e-9), len(centres), spread)
    return replace(model, probes=_probes(model, few, recall))


def _probes(model: Model, few: np.ndarray, recall: float) -> int:
    """How many cells hold ``recall`` of the ten nearest sampled vectors of sampled queries."""
    if len(few) < 20 or len(model.centres) == 1:
        return len(model.centres)
    q = few[:PROBE_QUERIES]
    sim = q @ few.T
    sim[np.arange(len(q)), np.arange(len(q))] = -2
    near = model.cells(few)[np.argsort(-sim, 1)[:, :10]]
    order = np.argsort(model.probed(q), 1)
    rank = np.take_along_axis(order, near, 1)
    return int(np.quantile(rank, recall, method="higher")) + 1


class VectorIndex:
    """An index in a folder: ``model``, ``codes`` and ``vectors``, the last two by shard of the cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.parquet(f"{self.path}/model").first()  # one row, of at most MAX_CELLS centres
        self.kind, self.model = row["kind"], None
        if row["width"]:
            of = lambda c, *shape: np.frombuffer(bytes(row[c])).reshape(*shape)
            d = row["width"]
            self.model = Model(of("centres", -1, d), of("turn", d, d), of("low", d), of("step", d), row["probes"], of("spread", -1).astype(np.int64))

    @classmethod
    def build(cls, items: DataFrame, path: str, key: str = "chunk_id", vector: str = "embedding", recall: float = 0.97, cells: int | None = None) -> VectorIndex:
        """Fit, then index every item; what was in the folder is replaced."""
        spark, m = items.sparkSession, fit(items, key, vector, recall, cells)
        data = (m.width, m.probes, *(x.astype(np.float64).tobytes() for x in (m.centres, m.turn, m.low, m.step, m.spread))) if m else (0, 0, b"", b"", b"", b"", b"")
        schema = "kind string, width int, probes int, centres binary, turn binary, low binary, step binary, spread binary"
        spark.createDataFrame([(dict(items.dtypes)[key], *data)], schema).write.mode("overwrite").parquet(f"{path.rstrip('/')}/model")
        out = cls(spark, path)
        out._write(items, key, vector, "overwrite")
        return out

    def add(self, items: DataFrame, key: str = "chunk_id", vector: str = "embedding") -> None:
        """Index further items under the same centres."""
        self._write(items, key, vector, "append")

    def _write(self, items: DataFrame, key: str, vector: str, mode: str) -> None:
        m, kind = self.model, self.kind
        if m is None:
            return

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("u"), m.width)
                cell = m.cells(x)
                code = m.encode(x, cell)
                share = (cell + np.asarray(b.column("h")) % m.spread[cell]) % SHARES
                yield pa.RecordBatch.from_arrays([pa.array(cell % SHARDS, pa.int32()), pa.array(cell, pa.int32()), pa.array(share, pa.int32()), b.column("k"), pa.array([c.tobytes() for c in code], pa.binary()), b.column("v")], names=["shard", "cell", "share", "k", "code", "v"])

        element = dict(items.dtypes)[vector]
        rows = _units(items, key, vector, m.width).withColumn("h", F.xxhash64("k")).mapInArrow(placed, f"shard int, cell int, share int, k {kind}, code binary, v {element}")
        dealt = lambda df: df.repartition("share", F.pmod(F.xxhash64("k"), F.lit(4)))
        ordered = dealt(rows).sortWithinPartitions("shard", "cell", "k")
        ordered.select("shard", "cell", "share", "k", "code", F.col("v").cast("array<double>").alias("v")).write.mode(mode).partitionBy("shard").parquet(f"{self.path}/vectors")
        size = (m.width + 1) // 2

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for run in runs_of(b, ["cell", "share"]):
                    cell, share = run.column("cell")[0].as_py(), run.column("share")[0].as_py()
                    for at in range(0, run.num_rows, BLOCK):
                        part = run.slice(at, BLOCK)
                        codes = b"".join(part.column("code").to_pylist())
                        assert len(codes) == part.num_rows * size
                        keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("k"))
                        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([share], pa.int32()), keys, pa.array([codes], pa.binary()), pa.array([cell % SHARDS], pa.int32())], names=["cell", "share", "keys", "codes", "shard"])

        stored = self.spark.read.parquet(f"{self.path}/vectors") if mode == "overwrite" else rows
        stored = dealt(stored.select("cell", "share", "k", "code")).sortWithinPartitions("cell", "share", "k")
        blocks = stored.mapInArrow(packed, f"cell int, share int, keys array<{kind}>, codes binary, shard int")
        blocks.write.mode(mode).partitionBy("shard").parquet(f"{self.path}/codes")

    def _empty(self, more: str) -> DataFrame:
        return self.spark.createDataFrame([], f"query {self.kind}, key {self.kind}, {more}")

    def candidates(self, queries: DataFrame, n: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
        """(query, key, cell, estimate): each query's n best items by their codes."""
        m, kind = self.model, self.kind
        if m is None:
            return self._empty("cell int, estimate double")

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, QUERY_BLOCK):
                    part = b.slice(lo, QUERY_BLOCK)
                    cells = m.probed(_matrix(part.column("u"), m.width))
                    at, share = m.shares(cells.ravel())
                    who, cell = at // cells.shape[1], cells.ravel()[at]
                    order = np.lexsort((share, who))
                    who, share, cell = who[order], share[order], cell[order]
                    new = np.flatnonzero(np.r_[True, (np.diff(who) != 0) | (np.diff(share) != 0)])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(who)].astype(np.int32)), pa.array(cell, pa.int32()))
                    take = pa.array(who[new])
                    yield pa.RecordBatch.from_arrays([pa.array(share[new], pa.int32()), lists, part.column("k").take(take), part.column("u").take(take)], names=["share", "cells", "query", "u"])

        def best(held: tuple, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keys, of, y, rest = held
            step = max(1, min(QUERY_BLOCK, PAIRS // len(of)))
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                q, cells = _matrix(part.column("u"), m.width), part.column("cells")
                looked, row = np.asarray(cells.flatten()), np.repeat(np.arange(len(q)), np.asarray(cells.value_lengths()))
                e = np.full((len(q), len(of)), -np.inf)
                for cell in np.unique(looked):
                    at, asks = np.flatnonzero(of == cell), row[looked == cell]
                    if len(at):
                        e[np.ix_(asks, at)] = np.round(m.estimate(q[asks], y[at], rest[at]).astype(float), 9)
                least = np.partition(-e, min(n, len(of)) - 1, 1)[:, min(n, len(of)) - 1]
                r, c = np.nonzero((-e <= least[:, None]) & (e > -np.inf))  # a row's n best, and what is equal to the last of them
                order = np.lexsort((c, -e[r, c], r))  # held in the order of the keys, so ties go by key
                r, c = r[order], c[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < n
                r, c = r[first], c[first]
                yield pa.RecordBatch.from_arrays([part.column("query").take(pa.array(r)), keys.take(pa.array(c)), pa.array(of[c], pa.int32()), pa.array(e[r, c])], names=["query", "key", "cell", "estimate"])

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, parts, held = None, [], None
            for batch in batches:
                for b in runs_of(batch, ["share", "asks"]):
                    if b.column("share")[0].as_py() != now:
                        now, parts, held = b.column("share")[0].as_py(), [], None
                    if not b.column("asks")[0].as_py():
                        parts.append(b.select(["cell", "keys", "codes"]))
                    elif parts:
                        if held is None:
                            table = pa.Table.from_batches(parts).combine_chunks()
                            keys = table.column("keys").combine_chunks()
                            of = np.repeat(np.asarray(table.column("cell")), np.asarray(keys.value_lengths()))
                            codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(-1, (m.width + 1) // 2)
                            order = np.argsort(np.asarray(keys.flatten()), kind="stable")
                            held = (keys.flatten().take(pa.array(order)), of[order], *m.decode(of[order], codes[order]))
                        yield from best(held, b)

        probes = _units(queries, key, vector, m.width).select(F.col("k").cast(kind).alias("k"), "u").mapInArrow(asked, f"share int, cells array<int>, query {kind}, u array<double>").withColumn("asks", F.lit(True))
        codes = self.spark.read.parquet(f"{self.path}/codes").select("share", "cell", "keys", "codes", F.lit(False).alias("asks"))
        both = codes.unionByName(probes, allowMissingColumns=True).repartition("share").sortWithinPartitions("share", "asks")
        pairs = both.mapInArrow(met, f"query {kind}, key {kind}, cell int, estimate double")
        return _top(pairs, n, "estimate")

    def search(self, queries: DataFrame, k: int = 10, key: str = "chunk_id", vector: str = "embedding", rerank: int = 4) -> DataFrame:
        """(query, key, similarity): the k nearest items by exact cosine among each query's ``rerank`` x k best estimates."""
        m = self.model
        if m is None:
            return self._empty("similarity double")
        near = self.candidates(queries, k * rerank, key, vector).select("query", "key", "cell")
        asked = _units(queries, key, vector, m.width).select(F.col("k").alias("query"), F.col("u").alias("_q")).dropDuplicates(["query"])
        items = self.spark.read.parquet(f"{self.path}/vectors").select("shard", "cell", F.col("k").alias("key"), F.col("v").alias("_v"))
        both = near.distinct().withColumn("shard", F.col("cell") % SHARDS).join(items, ["shard", "cell", "key"]).join(asked, "query")
        scored = both.select("query", "key", F.round(F.coalesce(V.cosine(F.col("_q"), F.col("_v")), F.lit(0.0)), 6).alias("similarity"))
        return _top(scored, k, "similarity")


def _top(rows: DataFrame, k: int, by: str) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc(by), "key")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
