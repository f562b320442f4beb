"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

The weight of a five-word shingle is its count. Each element of a document sends arrivals of a Poisson
process, with its weight as rate, to random registers; a register keeps the element that came first, and
elements whose next arrival comes after every register's first stop early. Registers of two documents agree
with the probability Jaccard similarity. Documents that agree on a band become candidates, and only pairs
whose exact probability Jaccard reaches the threshold are linked.

Documents with the same words are one class. In each bucket the members are first compared with its most
central class. Only buckets in which different components are left are compared further, and only across
components: small ones pair by pair, larger ones in blocks. The members of a bucket's largest component need
not be compared with each other, so a bucket of m others and M members of that component takes work in
proportion to m (m + M), and no link between components is lost. A pair of a small bucket is verified if enough of its
registers agree: of pairs at the threshold about one in a million has fewer, while a band lets one in
fifteen thousand slip.

Defined results: a text without a word (null and empty included) is alone in its class; a text of fewer than
five words is one shingle; a null id stays out of every class; repeated rows are one class; an empty table
gives an empty result.
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
from .hashing import mix, shingles, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: Parts into which the members of a bucket are dealt to meet what is known of it.
SALTS = 16
#: Members of a bucket that is compared pair by pair; larger ones are compared in blocks.
SMALL = 16
#: Members and bytes of a block, on average; two blocks meet in one task.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Elements of one step of a block's comparison; bounds its matrices.
COLUMNS = 2048
#: Least number of the BANDS x ROWS registers that agree for a pair to be verified: 0.8 less 4.8 deviations.
AGREE = 75
_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, element) with counts, ordered by row and element; ``row`` is ascending."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(row) else np.zeros(0, np.int64)
    return row[new], h[new], np.diff(np.r_[new, len(row)])


def prob_minhash(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(rows x m) registers: the element that arrived first. All rows advance by one arrival a round."""
    first = np.full(rows * m, np.inf)
    sig = np.zeros(rows * m, np.uint64)
    active, time = np.arange(len(row)), np.zeros(len(row))
    last = np.full(rows, np.inf)
    k = 0
    while len(active):
        k += 1
        r = mix(h[active] + np.uint64(k * int(_STEP) % (1 << 64)))
        gap = -np.log((np.float64(1.0) + (r >> np.uint64(11))) / float(1 << 53))
        time[active] += gap / weight[active]
        active_rows = row[active]
        live = time[active] <= last[active_rows]
        active, r = active[live], r[live]
        if not len(active):
            break
        slot = row[active] * m + ((mix(r ^ _STEP) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        t = time[active]
        np.minimum.at(first, slot, t)
        won = first[slot] == t
        sig[slot[won]] = h[active[won]]
        last = first.reshape(rows, m).max(1)
        active = active[t <= last[row[active]]]
    return sig.reshape(rows, m)


def bands(sig: np.ndarray) -> np.ndarray:
    """(rows x BANDS) hashes of ROWS registers each."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(ROWS):
        out = mix(out * _STEP + sig.reshape(len(sig), BANDS, ROWS)[:, :, k])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted distinct elements, weights).

    The sum over shared elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i); for each i the sum
    over j follows from the ratios x_j / y_j sorted once.
    """
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = a[1].astype(float), b[1].astype(float)
    xs, ys = x[ia], y[ib]
    only_x, only_y = x.sum() - xs.sum(), y.sum() - ys.sum()
    ratio = xs / ys
    order = np.argsort(ratio, kind="stable")
    cx, cy = np.r_[0.0, np.cumsum(xs[order])], np.r_[0.0, np.cumsum(ys[order])]
    k = np.searchsorted(ratio[order], ratio, "right")  # j with x_j / y_j <= x_i / y_i take the y side
    total = (cx[-1] - cx[k] + only_x) / xs + (cy[k] + only_y) / ys
    return float((1.0 / total).sum())


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, bands, sketch): a 128-bit key of the word sequence, band hashes (null without words), 16 bits of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            key, found, has = np.zeros((n, 2), np.uint64), np.zeros((n, BANDS), np.int64), np.zeros(n, bool)
            sketch = np.zeros((n, BANDS * ROWS), "<u2")
            for lo, rows, row, h in words(batch.column("text")):
                srow, sh = shingles(row, h, SHINGLE)
                erow, eh, w = weighted(srow, sh)
                sig = prob_minhash(erow, eh, w.astype(float), rows)
                found[lo : lo + rows] = bands(sig)
                sketch[lo : lo + rows] = sig >> np.uint64(48)
                counts = np.bincount(row, minlength=rows)
                has[lo : lo + rows] = counts > 0
                at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                for c in (0, 1):  # order-dependent sums of word hashes, modulo 2^64
                    np.add.at(key[:, c], lo + row, mix(h + (at.astype(np.uint64) * 2 + np.uint64(c + 1)) * _STEP))
            lists = pa.array([x if ok else None for x, ok in zip(found, has, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)), lists, pa.array([x.tobytes() for x in sketch], pa.binary())], names=["doc_id", "k1", "k2", "bands", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, bands array<bigint>, sketch binary")


def elements(docs: DataFrame) -> DataFrame:
    """(cls, e, w): sorted elements (64-bit hashes) and their counts, as bytes, of (cls, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            es, ws = [b""] * batch.num_rows, [b""] * batch.num_rows
            for lo, rows, row, h in words(batch.column("text")):
                srow, sh = shingles(row, h, SHINGLE)
                erow, eh, w = weighted(srow, sh)
                cut = np.searchsorted(erow, np.arange(rows + 1))
                for k in range(rows):
                    es[lo + k] = eh[cut[k] : cut[k + 1]].astype("<u8").tobytes()
                    ws[lo + k] = w[cut[k] : cut[k + 1]].astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(es, pa.binary()), pa.array(ws, pa.binary())], names=["cls", "e", "w"])

    return docs.mapInArrow(run, "cls bigint, e binary, w binary")


def verify(pairs: DataFrame, els: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c, k, kind: np.frombuffer(batch.column(c)[k].as_buffer(), kind)  # noqa: B023, E731
            ok = [similarity((get("ea", k, "<u8"), get("wa", k, "<u4")), (get("eb", k, "<u8"), get("wb", k, "<u4"))) >= threshold - 1e-12 for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    first = pairs.join(els.toDF("a", "ea", "wa"), "a")
    both = first.join(els.toDF("b", "eb", "wb"), "b")
    return both.select("a", "b", "ea", "wa", "eb", "wb").mapInArrow(run, "a bigint, b bigint")


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose sketches (cls, sketch) agree in at least AGREE registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= AGREE))

    both = pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: doc_id, class_id (same words), component_id (linked classes), n_docs, kept."""
    spark = docs.sparkSession
    sigs = written(signatures(docs, id_col, text_col), "signatures")
    named = sigs.where("bands is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("cls"), F.count(F.lit(1)).alias("n"), F.first(F.struct("bands", "sketch")).alias("s"))
    classes = written(named.select("k1", "k2", "cls", "n", "s.*"), "classes")
    sketches = classes.select("cls", "sketch")
    bucket = ["band", "hash"]
    rows = classes.select("cls", F.posexplode("bands").alias(*bucket))
    shared = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = _meet(rows, shared)
    # the more members a class meets, the more central it is: an original meets its copies oftener than they each other
    central = met.groupBy("cls").agg((-F.sum("n")).alias("rank"))
    met = written(met.drop("n").join(central, "cls"), "met")
    hub = met.groupBy(*bucket).agg(F.min(F.struct("rank", "cls")).alias("hub"))
    links = _linked(docs, id_col, text_col, _pairs(_meet(met, hub).where(F.col("cls") != F.col("hub.cls"))), sketches, threshold)
    comp = written(components(links), "components")
    # buckets in which different components are left
    left = met.join(comp.toDF("cls", "comp"), "cls", "left").select(*bucket, "cls", F.coalesce("comp", "cls").alias("comp"))
    parts = left.groupBy(*bucket, "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy(*bucket).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "comp"))["comp"].alias("major")).where("k > 1").drop("k")
    left = written(_meet(left, mixed), "left")
    small = left.where(F.col("n") <= SMALL).drop("n", "major")
    other = small.select(*bucket, F.struct("cls", "comp").alias("hub"))
    found = _linked(docs, id_col, text_col, _pairs(small.join(other, bucket).where((F.col("cls") < F.col("hub.cls")) & (F.col("comp") != F.col("hub.comp")))), sketches, threshold)
    large = left.where(F.col("n") > SMALL)
    if not large.isEmpty():
        found = found.union(written(block_links(large, _elements_of(docs, id_col, text_col, large), threshold), "block-links"))
    if not found.isEmpty():
        comp = written(components(links.union(found)), "components")
    named = comp.toDF("cls", "component")
    found = classes.select("k1", "k2", "cls", "n").join(named, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    found = written(found, "named")
    total = found.groupBy("component").agg(F.sum("n").alias("n_docs"))
    found = found.join(total, "component")
    has = sigs.where("bands is not null and doc_id is not null").select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", F.col("cls").alias("class_id"), F.col("component").alias("component_id"), "n_docs")
    none = sigs.where("bands is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_docs"))
    return has.union(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _meet(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` (band, hash, cls, ...) joined with one row per bucket, each bucket's rows dealt to SALTS parts: a hot bucket is not one task's."""
    salted = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(salted, ["band", "hash", "salt"]).drop("salt")


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of rows with cls and hub.cls."""
    return written(met.select(F.least("hub.cls", "cls").alias("a"), F.greatest("hub.cls", "cls").alias("b")).distinct(), "pairs")


def _elements_of(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame) -> DataFrame:
    """Elements of the classes in column cls; only their texts are read again."""
    wanted = written(classes.select("cls").distinct(), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("cls"), F.col(text_col).alias("text")).join(wanted, "cls", "left_semi")
    return written(elements(texts).dropDuplicates(["cls"]), "elements")


def _linked(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs that verification links."""
    good = written(likely(pairs, sketches), "likely")
    if good.isEmpty():
        return good
    els = _elements_of(docs, id_col, text_col, good.select(F.col("a").alias("cls")).union(good.select("b")))
    return written(verify(good, els, threshold), "links")


def block_links(members: DataFrame, els: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) that join the components of each bucket, of (band, hash, cls, comp, major) rows.

    The members outside a bucket's major component are dealt to ``ms`` blocks and meet each other and all
    ``mb`` blocks of the major component; each meeting of two blocks is one group, of bounded size.
    """
    bucket, minor = ["band", "hash"], F.col("comp") != F.col("major")
    sized = members.join(els.select("cls", (F.octet_length("e") + F.octet_length("w")).alias("size")), "cls")
    blocks = lambda of: F.greatest(F.lit(1), F.ceil(F.count(F.when(of, 1)) / BLOCK), F.ceil(F.sum(F.when(of, F.col("size")).otherwise(0)) / BLOCK_BYTES)).cast("int")
    sizes = sized.groupBy(*bucket).agg(blocks(minor).alias("ms"), blocks(~minor).alias("mb"))
    place = F.xxhash64("cls", "band")
    dealt = _meet(members, sizes).withColumn("k", F.when(minor, F.pmod(place, F.col("ms"))).otherwise(F.col("ms") + F.pmod(place, F.col("mb"))).cast("int"))
    meets = F.sequence(F.lit(0), F.when(minor, F.col("ms") + F.col("mb")).otherwise(F.col("ms")) - 1)
    cells = dealt.withColumn("o", F.explode(meets)).select(*bucket, F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "cls", "comp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf["k"].to_numpy()
        left, right = np.flatnonzero(k == pdf["i"].iloc[0]), np.flatnonzero(k == pdf["j"].iloc[0])
        sets = [(np.frombuffer(e, "<u8"), np.frombuffer(w, "<u4")) for e, w in zip(pdf["e"], pdf["w"], strict=True)]
        cls = pdf["cls"].to_numpy(np.int64)
        found = joining(sets, pdf["comp"].to_numpy(np.int64), left, right, threshold) if len(left) and len(right) else []
        a, b = (cls[[x[c] for x in found]] if found else np.zeros(0, np.int64) for c in (0, 1))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return cells.join(els, "cls").groupBy(*bucket, "i", "j").applyInPandas(run, "a bigint, b bigint")


def joining(sets: list[tuple[np.ndarray, np.ndarray]], comp: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of ``left`` x ``right`` that reach the threshold, as many as it takes to join their components.

    Sets without repeats are settled by their common elements. Of others, the similarity is at most the
    weight that either has in common elements; pairs within that bound are verified.
    """
    sizes = np.array([len(e) for e, _ in sets])
    total = np.array([w.sum() for _, w in sets], float)
    doc, weight = np.repeat(np.arange(len(sets)), sizes), np.concatenate([w for _, w in sets]).astype(np.float32)
    _, column, uses = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True, return_counts=True)
    keep = np.flatnonzero(uses[column] > 1)
    keep = keep[np.argsort(column[keep], kind="stable")]
    number = (np.cumsum(uses > 1) - 1)[column[keep]]
    doc, weight = doc[keep], weight[keep]
    plain = total == sizes
    common, mine, yours = (np.zeros((len(left), len(right))) for _ in range(3))
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        s, e = np.searchsorted(number, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[doc[s:e], number[s:e] - lo] = weight[s:e]
        there = (m > 0).astype(np.float32)
        common += there[left] @ there[right].T
        if not plain.all():
            mine += m[left] @ there[right].T
            yours += there[left] @ m[right].T
    across = comp[left][:, None] != comp[right][None, :]
    if np.array_equal(left, right):
        across &= np.triu(np.ones(across.shape, bool), 1)
    both = plain[left][:, None] & plain[right][None, :]
    sure = across & both & (common >= threshold * (sizes[left][:, None] + sizes[right][None, :] - common) - 1e-9)
    close = across & ~both & (mine >= threshold * total[left][:, None] - 1e-6) & (yours >= threshold * total[right][None, :] - 1e-6)
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for pairs, known in ((np.argwhere(sure), True), (np.argwhere(close), False)):
        for x, y in pairs.tolist():
            a, b = int(left[x]), int(right[y])
            ra, rb = find(int(comp[a])), find(int(comp[b]))
            if ra != rb and (known or similarity(sets[a], sets[b]) >= threshold - 1e-12):
                root[ra] = rb
                out.append((a, b))
    return out
