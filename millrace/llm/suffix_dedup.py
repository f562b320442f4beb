"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

The texts are cut at content-defined anchors (a 24-byte gram whose hash is least in some window of WINDOW
grams), so equal strings are cut alike. Each anchor starts a phrase, and a text becomes a string of phrases.
Only regions that can hold a repeat take part: every string of LENGTH bytes has a coarse anchor among its first
COARSE grams, and the bytes from there on to the string's end must occur twice.

The suffixes of the phrase strings are sorted by difference cover. Positions 1 and 2 modulo 3 are sampled; their
triples are sorted, in ranges over all tasks, and each suffix is named by its place in that order. Names that
occur again and stand for less than LENGTH bytes are sorted on by the names of the sampled suffixes that follow
(the triples of the string of names), which refines the order, until none is left. The suffixes at positions 0
modulo 3 are merged in: a suffix is compared with one of residue 1 by its first phrase and the place of the
suffix after it, with one of residue 2 by two phrases and the place of the suffix after those. Neighbours in
these orders are compared. Those that agree on LENGTH bytes in whole phrases are repeats. Those that agree on
their first phrase can be the inside of a repeat: the first inner phrase of any repeated string occurs again.

What is left are the ends of repeats, shorter than whole phrases: windows of LENGTH bytes whose first inner
phrase occurs again but which no repeat found so far covers. They are compared in blocks that share their
core: first as whole blocks, then, where a block is unique, in slices of SLICE windows, and in the slices at the
very ends window by window, under a 64-bit hash of the window next to that of its core, which are 128 bits of
different strings.

Phrases are compared by 64-bit hashes. For a wrong byte, two different phrases with equal hashes must follow
equal phrases; among 10^12 pairs of suffixes that part after a common prefix the chance of one is below 10^-7.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; repeated rows are documents of
their own, so whole copies of at least LENGTH bytes go from both; a null id is passed through; an empty table
gives an empty result. Texts are known by their SHA-256, so no pass depends on the order in which rows arrive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import combined, release, written
from .hashing import buffers, mix, powers, prefix_sums, steps

LENGTH = 400
GRAM = 24
COARSE, WINDOW = 256, 94
#: A window's first inner anchor is at least INNER bytes after its start, and at most INNER + WINDOW. WINDOW is the
#: largest for which the phrase from there on lies where equal windows have equal anchors: 4 WINDOW + GRAM <= LENGTH + 2.
INNER = WINDOW - 1
#: Windows of a slice of a block.
SLICE = 8
#: Bytes from a window's first inner anchor that every such window holds.
CORE = LENGTH - INNER - WINDOW


def grams(data: np.ndarray, sums: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hash of the n bytes from each position."""
    count = len(data) - n + 1
    return mix((sums[n:] - sums[:-n]) * powers(len(data))[1][:count]) if count > 0 else np.zeros(0, np.uint64)


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of w values, by doubling."""
    out, width = x, 1
    while 2 * width <= w:
        out = pick(out[:-width], out[width:])
        width *= 2
    return pick(out[: len(out) - (w - width)], out[w - width :]) if w > width else out


def anchors(data: np.ndarray, sums: np.ndarray, w: int) -> np.ndarray:
    """Positions whose gram has the least hash of some window of w grams; of equal grams, all."""
    h = (grams(data, sums) >> np.uint64(32)).astype(np.uint32)
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = _sliding(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint32)
    return np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), w, np.maximum) == h)


def hashed(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((sums[e] - sums[s]) * powers(int(s.max(initial=0)) + 1)[1][s] + (e - s).astype(np.uint64))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, sha, k): a text is known by its digest; k, its first 64 bits, is only used to filter."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    return rows.withColumn("k", F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint"))


def coarse(rows: DataFrame) -> DataFrame:
    """(k, pos, c): coarse anchors with the hash of the bytes that any string starting before them holds."""
    reach = LENGTH - COARSE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            keys = batch.column("k").to_numpy()
            for lo, hi in steps(off):
                part, ends = data[off[lo] : off[hi]], off[lo + 1 : hi + 1] - off[lo]
                if not len(part):
                    continue
                sums = prefix_sums(part)
                at = anchors(part, sums, min(COARSE, max(1, len(part) - GRAM + 1)))
                row = np.searchsorted(ends, at, "right")
                ok = at + reach <= ends[row]
                at, row = at[ok], row[ok]
                start = np.r_[0, ends[:-1]][row]
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo + row]), pa.array((at - start).astype(np.int64)), pa.array(hashed(sums, at, at + reach).view(np.int64))], names=["k", "pos", "c"])

    return rows.select("k", "text").mapInArrow(combined(run), "k bigint, pos bigint, c bigint")


def once_a_task(rows: DataFrame) -> DataFrame:
    """``rows`` (k, sha, text) without copies within a task, so that a hot text is not shuffled as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            new = []
            for x in batch.column("sha").to_pylist():
                new.append(x not in seen)
                seen.add(x)
            yield batch.filter(pa.array(new, pa.bool_()))

    return rows.mapInArrow(combined(run), rows.schema)


def phrases(texts: DataFrame) -> DataFrame:
    """One row per text, (tag, n, pos, p, c, e): the anchors in the regions that coarse anchors (column at) mark.

    pos: place; p: hash of the phrase; c: hash of its core; e: hash of all bytes that the windows cover whose
    first inner anchor it is (0: there is none); as packed arrays. An anchor past a gap follows a 0 in p.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            tags = batch.column("tag").to_pylist()
            for k in range(batch.num_rows):
                part = data[off[k] : off[k + 1]]
                n = len(part)
                sums = prefix_sums(part)
                at = anchors(part, sums, WINDOW)
                if n < LENGTH or not len(at):
                    continue
                near = np.zeros(n + 1, np.int32)
                marks = np.array(batch.column("at")[k].as_py(), np.int64)
                np.add.at(near, np.maximum(marks - COARSE, 0), 1)
                np.add.at(near, np.minimum(marks + LENGTH, n), -1)
                use = np.cumsum(near)[at] > 0
                lo, hi = _blocks(at, n)
                block = (hi >= lo) & (at + CORE <= n)
                e = np.zeros(len(at), np.uint64)
                e[block] = mix(hashed(sums, lo[block], hi[block] + LENGTH) + (at - lo)[block].astype(np.uint64)) | np.uint64(1)
                p = hashed(sums, at, np.r_[at[1:], n]) | np.uint64(1)
                p[~use] = 0
                keep = use | np.r_[False, use[:-1]]  # one anchor past each region ends its last phrase
                c = hashed(sums, at, np.minimum(at + CORE, n))
                e[~use] = 0
                yield pa.RecordBatch.from_arrays([pa.array([tags[k]]), pa.array([n]), *[pa.array([x[keep].tobytes()], pa.binary()) for x in (at.astype("<i8"), p, c, e, lo.astype("<i8"), hi.astype("<i8"))]], names=["tag", "n", "pos", "p", "c", "e", "lo", "hi"])

    return texts.select("tag", "text", "at").mapInArrow(combined(run), "tag bigint, n bigint, pos binary, p binary, c binary, e binary, lo binary, hi binary")


def _blocks(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows whose first inner anchor each anchor is."""
    prev = np.r_[-(1 << 40), at[:-1]]
    return np.maximum(np.maximum(prev - INNER + 1, at - INNER - WINDOW), 0), np.minimum(at - INNER, n - LENGTH)


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    """The value k places on; 0 past the end."""
    return np.r_[x[k:], np.zeros(min(k, len(x)), x.dtype)]


#: Texts whose strings are taken together by array operations.
TOGETHER = 256


def _flat(batch: pa.RecordBatch, c: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of packed arrays, one text after the other, and their count in each text."""
    arr = batch.column(c).cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data.view(kind), np.diff(off) // np.dtype(kind).itemsize


def _strings(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Strings of TOGETHER texts at a time: their rows, phrase hashes (0 in gaps, else odd), lengths in bytes, text and place of each phrase, and where each text starts.

    Two phrases that aren't there (hash 0, length 0, place -1) follow each text.
    """
    for lo in range(0, batch.num_rows, TOGETHER):
        part = batch.slice(lo, TOGETHER)
        (p, n), (pos, _) = _flat(part, "p", np.int64), _flat(part, "pos", np.int64)
        row, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        after = np.r_[pos[1:], np.zeros(min(1, len(pos)), np.int64)]
        after[(first + n - 1)[n > 0]] = part.column("n").to_numpy()[n > 0]
        start = first + 2 * np.arange(len(n))
        hashes, size, place = np.zeros(len(p) + 2 * len(n), np.int64), np.zeros(len(p) + 2 * len(n), np.int64), np.full(len(p) + 2 * len(n), -1)
        to = np.arange(len(p)) + 2 * row
        hashes[to], size[to], place[to] = p, np.where(p != 0, after - pos, 0), to - start[row]
        yield part, hashes, size, np.repeat(np.arange(len(n)), n + 2), place, start


KEYS = ["k0", "k1", "k2"]
SORTED = "tag bigint, idx int, k0 bigint, k1 bigint, k2 bigint, bytes int, whole boolean"


def _rows(tag: np.ndarray | int, idx: np.ndarray, keys: list[np.ndarray], size: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), tag)), pa.array(idx.astype(np.int32)), *[pa.array(np.asarray(x, np.int64)) for x in keys], pa.array(size.astype(np.int32)), pa.array(whole)], names=["tag", "idx", *KEYS, "bytes", "whole"])


def triples(strings: DataFrame) -> DataFrame:
    """The sampled suffixes with their first three phrases as keys; a phrase that isn't there is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, p, size, text, place, _ in _strings(batch):
                one = np.where(p != 0, _ahead(p, 1), 0)
                two = np.where(one != 0, _ahead(p, 2), 0)
                total = size + np.where(one != 0, _ahead(size, 1), 0) + np.where(two != 0, _ahead(size, 2), 0)
                at = np.flatnonzero((place % 3 != 0) & (p != 0))
                yield _rows(part.column("tag").to_numpy()[text[at]], place[at], [p[at], one[at], two[at]], total[at], two[at] != 0)

    return strings.select("tag", "n", "pos", "p").mapInArrow(combined(run), SORTED)


def ranked(rows: DataFrame, name: str, near_only: bool = False) -> DataFrame:
    """Sorts ``rows`` (as SORTED, a written table) by their keys and compares neighbours.

    Adds place (rows before the first with equal keys), inner (rows with its first key before that one), again
    (a neighbour has equal keys) and near (a neighbour has the same first key). ``near_only`` leaves out rows without
    such a neighbour, and the first key; only the groups at a task's borders can still get one, and are kept.
    Tasks hold ranges of the order, which may split even the rows of one key; what crosses their borders follows
    from one row per task.
    """
    names = [x.split()[0] for x in SORTED.split(", ")]
    edge = "struct<n:bigint,first:array<bigint>,last:array<bigint>,start:bigint,outer:bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, last, n, start, outer = None, None, None, 0, 0, 0

        def flush(same: bool, kin: bool, over: bool = False) -> pa.RecordBatch:
            batch, eq, group_eq, at, out = held
            again, near = eq | np.r_[eq[1:], same], group_eq | np.r_[group_eq[1:], kin]
            columns = [batch.column(c) for c in ("pid", "tag", "idx", "k0", "bytes", "whole")]
            if near_only:
                columns[3] = pa.nulls(len(at), pa.int64())
            whole = pa.RecordBatch.from_arrays([*columns, pa.array(at), pa.array(out), pa.array(again), pa.array(near), pa.nulls(len(at), edge_type)], names=out_names)
            return whole.filter(pa.array(again | near | (out == 0) | (over & (out == out[-1])))) if near_only else whole

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(c).to_numpy() for c in KEYS])
            same, kin = last is not None and bool((x[:, 0] == last).all()), last is not None and bool(x[0, 0] == last[0])
            if held is not None:
                yield flush(same, kin)
            else:
                pid, first = batch.column("pid")[0].as_py(), x[:, 0]
            eq, group_eq = np.r_[same, (x[:, 1:] == x[:, :-1]).all(0)], np.r_[kin, x[0, 1:] == x[0, :-1]]
            here = np.arange(n, n + batch.num_rows)
            at = np.maximum.accumulate(np.where(eq, start, here))
            out = np.maximum.accumulate(np.where(group_eq, outer, here))
            held, last, n, start, outer = (batch, eq, group_eq, at, out), x[:, -1], n + batch.num_rows, int(at[-1]), int(out[-1])
        if held is not None:
            yield flush(False, False, True)
            summary = {"n": n, "first": first.tolist(), "last": last.tolist(), "start": start, "outer": outer}
            none = [pa.array([None], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), *none, pa.array([summary], edge_type)], names=out_names)

    longs = pa.list_(pa.int64())
    edge_type = pa.struct([("n", pa.int64()), ("first", longs), ("last", longs), ("start", pa.int64()), ("outer", pa.int64())])
    out_names = ["pid", "tag", "idx", "k0", "bytes", "whole", "start", "outer", "again", "near", "edge"]
    kinds = f"pid int, tag bigint, idx int, k0 bigint, bytes int, whole boolean, start bigint, outer bigint, again boolean, near boolean, edge {edge}"
    order = rows.repartitionByRange(*KEYS, "tag", "idx").sortWithinPartitions(*KEYS).select(F.spark_partition_id().alias("pid"), *names)
    table = written(order.mapInArrow(combined(run), kinds), name, dictionary=False)  # hashes and tags in no order
    spark, fixes, before = rows.sparkSession, [], None
    for r in sorted(table.where("edge is not null").select("pid", "edge").collect(), key=lambda r: r["pid"]):  # one row per task
        e, off = r["edge"], before["end"] if before else 0
        same, kin = bool(before) and before["last"] == e["first"], bool(before) and before["last"][0] == e["first"][0]
        if before:
            fixes[-1][6:8] = [same, kin]
        s0, o0 = before["start"] if same else off, before["outer"] if kin else off
        fixes.append([r["pid"], off, s0, o0, same, kin, False, False, e["start"], e["outer"]])
        before = {"end": off + e["n"], "last": e["last"], "start": off + e["start"] if e["start"] else s0, "outer": off + e["outer"] if e["outer"] else o0}
    kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.bool_()] * 4, *[pa.int64()] * 2]
    fix = spark.createDataFrame(pa.table([pa.array([f[k] for f in fixes], t) for k, t in enumerate(kinds)], names=["pid", "off", "s0", "o0", "same", "kin", "same_next", "kin_next", "last_start", "last_outer"]))
    full = table.where("edge is null").join(F.broadcast(fix), "pid")  # one row per task
    place = F.when(F.col("start") == 0, F.col("s0")).otherwise(F.col("off") + F.col("start"))
    outer_ = F.when(F.col("outer") == 0, F.col("o0")).otherwise(F.col("off") + F.col("outer"))
    again = F.col("again") | ((F.col("start") == 0) & F.col("same")) | ((F.col("start") == F.col("last_start")) & F.col("same_next"))
    near = F.col("near") | ((F.col("outer") == 0) & F.col("kin")) | ((F.col("outer") == F.col("last_outer")) & F.col("kin_next"))
    return full.select("tag", "idx", "k0", "bytes", "whole", place.alias("place"), (place - outer_).alias("inner"), again.alias("again"), near.alias("near"))


#: What is known of a text's sampled suffixes: idx, name (place in the order, from 1), bytes that it stands for, flags.
STATE = "tag bigint, idx binary, name binary, bytes binary, flags binary"
AGAIN, WHOLE, NEAR = 1, 2, 4


def _listed(rows: DataFrame, *extra) -> DataFrame:
    """(tag, x): the rows of each text as one list."""
    return rows.groupBy("tag").agg(F.collect_list(F.struct("idx", *extra)).alias("x"))


def _lists(batch: pa.RecordBatch, k: int) -> dict[str, np.ndarray]:
    x = batch.column("x")[k].values
    return {f.name: x.field(f.name).to_numpy(zero_copy_only=False) for f in x.type} if x is not None else {}


def _packed(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("idx", np.int32), ("name", np.int64), ("bytes", np.int32), ("flags", np.uint8))]


def _state(tag: int, idx: np.ndarray, name: np.ndarray, size: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tag]), *[pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary()) for x, t in ((idx, np.int32), (name, np.int64), (size, np.int32), (flags, np.uint8))]], names=["tag", "idx", "name", "bytes", "flags"])


def first_names(order: DataFrame) -> DataFrame:
    """State from the sorted triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = _lists(batch, k)
                at = np.argsort(x["idx"], kind="stable")
                flags = x["again"] * AGAIN + x["whole"] * WHOLE + x["near"] * NEAR
                yield _state(batch.column("tag")[k].as_py(), x["idx"][at], x["place"][at] + 1, x["bytes"][at], flags[at])

    return _listed(order, "place", "bytes", "whole", "again", "near").mapInArrow(combined(run), STATE)


def _open(size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Names to sort on: they occur again, are followed by a phrase, and stand for too few bytes."""
    return ((flags & (AGAIN | WHOLE)) == AGAIN | WHOLE) & (size < LENGTH)


def longer(state: DataFrame, step: int) -> DataFrame:
    """Triples of the string of names: an open name and the two names ``step`` and 2 ``step`` phrases on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                idx, name, size, flags = _packed(batch, k)
                at = np.flatnonzero(_open(size, flags))
                keys, total, whole = [name[at]], size[at].astype(np.int64), np.ones(len(at), bool)
                for j in (1, 2):
                    to = np.minimum(np.searchsorted(idx, idx[at] + j * step), len(idx) - 1)
                    there = whole & (idx[to] == idx[at] + j * step)
                    keys.append(np.where(there, name[to], 0))
                    total += np.where(there, size[to], 0)
                    whole = there & (flags[to] & WHOLE > 0)
                yield _rows(batch.column("tag")[k].as_py(), idx[at], keys, np.minimum(total, 1 << 30), whole)

    return state.mapInArrow(combined(run), SORTED)


def refined(state: DataFrame, order: DataFrame) -> DataFrame:
    """State after the open names were sorted on: a name moves by its place among those that were equal to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                idx, name, size, flags = (x.copy() for x in _packed(batch, k))
                x = _lists(batch, k)
                if x:
                    at = np.searchsorted(idx, x["idx"])
                    name[at] = x["k0"] + x["inner"]
                    size[at] = x["bytes"]
                    flags[at] = (flags[at] & NEAR) + x["again"] * AGAIN + x["whole"] * WHOLE
                yield _state(batch.column("tag")[k].as_py(), idx, name, size, flags)

    return state.join(_listed(order, "k0", "inner", "bytes", "whole", "again"), "tag", "left").mapInArrow(combined(run), STATE)


def orders(strings: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of the two merges: residues 0 and 1 by a phrase and the name after it, 0 and 2 by two phrases and the name after them.

    Keys: the phrase, its last bit telling the merges apart; the next phrase or 0; the name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, p, size, text, place, start in _strings(batch):
                (idx, n), (name, _), (bytes_, _) = _flat(part, "idx", np.int32), _flat(part, "name", np.int64), _flat(part, "bytes", np.int32)
                names, covers = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
                to = np.repeat(start, n) + idx
                names[to], covers[to] = name, bytes_
                one, tags = _ahead(p, 1), part.column("tag").to_numpy()
                for o in (1, 2):
                    at = np.flatnonzero((p != 0) & np.isin(place % 3, (0, o)))
                    there = np.ones(len(at), bool) if o == 1 else one[at] != 0
                    after = np.where(there, names[at + o], 0)
                    cover = size[at] + np.where(there, covers[at + o] + (size[at + 1] if o == 2 else 0), 0)
                    yield _rows(tags[text[at]], place[at], [p[at] - (o == 2), one[at] if o == 2 else np.zeros(len(at)), after], np.minimum(cover, 1 << 30), there)

    return strings.select("tag", "n", "pos", "p").join(state, "tag").mapInArrow(combined(run), SORTED)


def repeats(strings: DataFrame, levels: int = 12) -> DataFrame:
    """(tag, near, start, end), packed per text: suffixes that share a phrase with a neighbour, and found repeats.

    ``strings`` as :func:`phrases` gives them, a written table.
    """
    rows = written(triples(strings), "triples", dictionary=False)
    state, step = written(first_names(ranked(rows, "order")), "names"), 3
    release(rows)
    for _ in range(levels):
        rows = written(longer(state, step), "longer", dictionary=False)
        if rows.isEmpty():
            break
        before, state, step = state, written(refined(state, ranked(rows, "order")), "names"), step * 3
        release(before, rows)
    rows = written(orders(strings, state), "merges", dictionary=False)
    found = _listed(ranked(rows, "order", True).where("near or again").select("tag", "idx", F.when(F.col("again"), F.col("bytes")).otherwise(0).alias("cover")), "cover")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pos = np.frombuffer(batch.column("pos")[k].as_buffer(), np.int64)
                idx, _, size, flags = _packed(batch, k)
                near, cover = np.zeros(len(pos), bool), np.zeros(len(pos), np.int64)
                near[idx] = flags & NEAR > 0
                cover[idx] = np.where(flags & AGAIN > 0, size, 0)
                x = _lists(batch, k)
                if x:
                    near[x["idx"]] = True
                    np.maximum.at(cover, x["idx"], x["cover"])
                full = cover >= LENGTH
                s, e = merged(pos[full], pos[full] + cover[full])
                yield pa.RecordBatch.from_arrays([batch.column("tag").slice(k, 1), *[pa.array([v.tobytes()], pa.binary()) for v in (near, s.astype(np.int64), e.astype(np.int64))]], names=["tag", "near", "start", "end"])

    out = written(strings.select("tag", "pos").join(state, "tag").join(found, "tag", "left").mapInArrow(combined(run), "tag bigint, near binary, start binary, end binary"), "repeats")
    release(rows, state)
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges; ranges that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, top = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > top[:-1]]
    return s[new], top[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]


def _held(s: np.ndarray, e: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether a merged range holds each block of windows."""
    at = np.searchsorted(s, lo, "right") - 1
    return (at >= 0) & (np.r_[e, 0][at] >= hi + LENGTH)


def blocks(strings: DataFrame, found: DataFrame) -> DataFrame:
    """(tag, c, e, pos, lo, hi, open): blocks of windows whose first phrases occur again; open: no found repeat holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c, e, pos, lo, hi, s, t = (np.frombuffer(batch.column(x)[k].as_buffer(), np.int64) for x in ("c", "e", "pos", "lo", "hi", "start", "end"))
                near = np.frombuffer(batch.column("near")[k].as_buffer(), bool)
                at = np.flatnonzero(near & (e != 0))
                columns = [pa.array(x[at]) for x in (c, e, pos, lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch.column("tag")[k].as_py())), *columns, pa.array(~_held(s, t, lo[at], hi[at]))], names=["tag", "c", "e", "pos", "lo", "hi", "open"])

    both = strings.select("tag", "c", "e", "pos", "lo", "hi").join(found, "tag")
    return both.mapInArrow(combined(run), "tag bigint, c bigint, e bigint, pos bigint, lo bigint, hi bigint, open boolean")


def slices(texts: DataFrame) -> DataFrame:
    """(tag, c, g, w, lo, hi): blocks (column blocks: structs of c, pos, lo and hi) in slices of SLICE windows.

    g: hash of the bytes that all windows of a whole slice share; w: hash of those that its windows cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            tags = batch.column("tag").to_numpy()
            for k in range(batch.num_rows):
                sums, x = prefix_sums(data[off[k] : off[k + 1]]), batch.column("blocks")[k].values
                c, pos, lo, hi = (x.field(f).to_numpy(zero_copy_only=False) for f in ("c", "pos", "lo", "hi"))
                first, last = (pos - hi) // SLICE, (pos - lo) // SLICE  # windows are dealt by their distance from the anchor
                count = last - first + 1
                at = np.repeat(np.arange(len(c)), count)
                m = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[at]
                lo, hi = np.maximum(lo[at], pos[at] - SLICE * m - SLICE + 1), np.minimum(hi[at], pos[at] - SLICE * m)
                top = pos[at] - SLICE * m
                g = hashed(sums, top, top + LENGTH - SLICE + 1) + mix(m.astype(np.uint64))
                w = mix(hashed(sums, lo, hi + LENGTH) + (top - lo).astype(np.uint64) * np.uint64(SLICE) + (top - hi).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tags[k])), pa.array(c[at]), *[pa.array(v.view(np.int64)) for v in (g, w)], pa.array(lo), pa.array(hi)], names=["tag", "c", "g", "w", "lo", "hi"])

    return texts.select("tag", "text", "blocks").mapInArrow(combined(run), "tag bigint, c bigint, g bigint, w bigint, lo bigint, hi bigint")


def windows(texts: DataFrame) -> DataFrame:
    """(tag, start, c, h): core and hash of all windows of slices. ``texts`` has tag, text and slices: structs of c, lo and hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            tags = batch.column("tag").to_numpy()
            for k in range(batch.num_rows):
                sums, x = prefix_sums(data[off[k] : off[k + 1]]), batch.column("slices")[k].values
                c, lo, hi = (x.field(f).to_numpy(zero_copy_only=False) for f in ("c", "lo", "hi"))
                count = hi - lo + 1
                i = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), tags[k])), pa.array(i), pa.array(np.repeat(c, count)), pa.array(hashed(sums, i, i + LENGTH).view(np.int64))], names=["tag", "start", "c", "h"])

    return texts.select("tag", "text", "slices").mapInArrow(combined(run), "tag bigint, start bigint, c bigint, h bigint")


def ends(texts: DataFrame, strings: DataFrame, found: DataFrame) -> DataFrame:
    """(tag, start, end): repeats that no found one holds, from the blocks at their ends."""
    every = written(blocks(strings, found), "blocks", dictionary=False)
    # a window that is found already may still be the partner of one that is not: all blocks of an open core take part
    cores = every.groupBy("c").agg(F.bool_or("open").alias("open"), F.count(F.lit(1)).alias("n")).where("open and n > 1").select("c")
    needed = written(every.select("tag", "c", "e", "pos", "lo", "hi").join(written(cores, "cores"), "c", "left_semi"), "needed", dictionary=False)
    release(every)
    one = lambda *names: [F.first(x).alias(x) for x in names]  # of one row, whichever it is
    again = F.count(F.lit(1)).alias("n")
    variants = written(needed.groupBy("c", "e").agg(again, *one("tag", "pos", "lo", "hi")), "variants", dictionary=False)
    same = variants.where("n > 1").select("c", "e")
    whole = needed.join(same, ["c", "e"], "left_semi").select("tag", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))
    mixed = variants.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("c")
    chosen = variants.join(mixed, "c", "left_semi").groupBy("tag").agg(F.collect_list(F.struct("c", "pos", "lo", "hi")).alias("blocks"))
    # a slice of which no other shares what all its windows hold has no repeated window; one that occurs again has no other
    parts = written(slices(texts.select("tag", "text").join(chosen, "tag")), "slices", dictionary=False)
    kinds = written(parts.groupBy("c", "g", "w").agg(again, *one("tag", "lo", "hi")), "kinds", dictionary=False)
    twice = kinds.where("n > 1").select("c", "g", "w")
    sliced = parts.join(twice, ["c", "g", "w"], "left_semi").select("tag", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))
    met = kinds.groupBy("c", "g").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("c", "g")
    left = kinds.join(met, ["c", "g"], "left_semi").groupBy("tag").agg(F.collect_list(F.struct("c", "lo", "hi")).alias("slices"))
    hashes = written(windows(texts.select("tag", "text").join(left, "tag")), "windows", dictionary=False)
    repeated = hashes.groupBy("c", "h").agg(again).where("n > 1").select("c", "h")
    single = hashes.join(repeated, ["c", "h"], "left_semi").select("tag", "start", (F.col("start") + LENGTH).alias("end"))
    out = written(whole.union(sliced).union(single), "ends")
    release(needed, variants, parts, kinds, hashes)
    return out


def cut(texts: DataFrame) -> DataFrame:
    """(sha, n_bytes, n_removed, n_spans, kept_sha256, removed) of texts with the repeats found in them (start, end, ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            out: list[list] = [[], [], [], [], []]
            for k in range(batch.num_rows):
                part = data[off[k] : off[k + 1]]
                s, e = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in ("start", "end"))
                more = batch.column("ends")[k].values
                if more is not None:
                    s, e = np.r_[s, more.field("start").to_numpy(zero_copy_only=False)], np.r_[e, more.field("end").to_numpy(zero_copy_only=False)]
                s, e = merged(s, e)
                keep, last = hashlib.sha256(), 0
                for a, b in zip(s.tolist(), e.tolist(), strict=True):
                    keep.update(part[last:a].tobytes())
                    last = b
                keep.update(part[last:].tobytes())
                for c, v in zip(out, (len(part), int((e - s).sum()), len(s), keep.hexdigest(), np.stack([s, e], 1).tolist()), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("sha"), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names=["sha", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return texts.select("sha", "text", "start", "end", "ends").mapInArrow(combined(run), "sha string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<array<bigint>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed ([start, end] in bytes)."""
    rows = _named(docs, id_col, text_col)
    plain = written(rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "plain")
    copies = plain.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", F.lit(True).alias("twin"))
    # regions that can hold a repeat; of texts that occur several times, one takes part
    marks = written(coarse(rows), "marks", dictionary=False)
    place = F.xxhash64("k", "pos")
    twice = marks.groupBy("c").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("c")
    at = marks.join(twice, "c", "left_semi").groupBy("k").agg(F.collect_set("pos").alias("at"))
    single = once_a_task(rows.select("k", "sha", "text")).join(at, "k").dropDuplicates(["k", "sha"])
    texts = written(single.select(F.monotonically_increasing_id().alias("tag"), "sha", "text", "at"), "texts")
    release(marks)
    strings = written(phrases(texts), "phrases", dictionary=False)
    found = repeats(strings)
    span = F.struct(F.col("start"), F.col("end"))
    last = ends(texts, strings, found).groupBy("tag").agg(F.collect_list(span).alias("ends"))
    changed = written(cut(texts.select("tag", "sha", "text").join(found.select("tag", "start", "end"), "tag").join(last, "tag", "left")), "changed")
    release(strings, found)
    none = F.lit(None).cast("array<array<bigint>>")
    known = plain.join(changed.drop("n_bytes").withColumn("hit", F.lit(True)), "sha", "left").join(copies, "sha", "left")
    gone = F.coalesce("twin", F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    all_of_it = F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    return known.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, all_of_it).otherwise(F.coalesce("removed", none, F.expr("cast(array() as array<array<bigint>>)"))).alias("removed"),
    )
