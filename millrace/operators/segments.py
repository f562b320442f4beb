"""Order-dependent folds over one text or one small list: records, segments, request packing, part planning."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import patterns as P
from ..functions.text import embed_tokens, first_group
from ..functions.timestamps import is_record_start
from ..sources.scratch import written
from .ordered import next_at_or_after, running_count, running_sum, same_keys
from .windows import KEYS

_START = re.compile(P.RECORD_START)


def record_groups(lines: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """Adds record_no: a line that starts with a timestamp opens a record, other lines continue it."""
    return running_count(lines, KEYS, "line_no", is_record_start(F.col("value")), "record_no", cfg.order_block)


def _join(parts: list[str], limit: int) -> list[str]:
    """Greedy packing with a newline between parts; leading blank parts of a buffer vanish."""
    out, buf = [], ""
    for p in parts:
        candidate = f"{buf}\n{p}" if buf else p
        if buf and len(candidate) > limit:
            out.append(buf)
            candidate = p
        buf = candidate
    return out + ([buf] if buf else [])


def split_content(content: str, limit: int) -> list[str]:
    """Segments of at most ``limit`` characters: whole records while they fit, else whole lines, else pieces."""
    if len(content) <= limit:
        return [content]
    records: list[list[str]] = []
    for line in content.split("\n"):
        if _START.search(line) or not records:
            records.append([])
        records[-1].append(line)
    units: list[str] = []
    for r in records:
        text = "\n".join(r).strip("\n") if len(r) > 1 else r[0]
        if len(text) <= limit:
            units.append(text)
            continue
        pieces = [line[k : k + limit] for line in r for k in range(0, max(len(line), 1), limit)]
        units += _join(pieces, limit)
    return _join(units, limit)


def content_segments(rows: DataFrame, key: str, text: str, limit: int = 5000) -> DataFrame:
    """(key, segment_no, segment) of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [split_content(t or "", limit) for t in pdf[text]]
            yield pd.DataFrame([(k, n, s) for k, ss in zip(pdf[key], parts, strict=True) for n, s in enumerate(ss)], columns=[key, "segment_no", "segment"])

    src = rows.select(key, text)
    return src.mapInPandas(run, f"{key} {dict(src.dtypes)[key]}, segment_no int, segment string")


def embed_packing(texts: DataFrame, group: str, order: str, text: str, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """Adds request: texts of a group in order, as many to a request as its token budget holds.

    A group is one work item's texts, a few at most.
    """
    cost = embed_tokens(F.substring(F.col(text), 1, cfg.embed_text_chars))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        out, used, request = [], 0, 0
        for t in pdf["tokens"]:
            if used and used + t > cfg.embed_request_tokens:
                request, used = request + 1, 0
            used += t
            out.append(request)
        return pdf.assign(request=out)

    src = texts.select(F.col(group).alias("grp"), F.col(order).alias("ord"), cost.alias("tokens"))
    kinds = dict(src.dtypes)
    return src.groupBy("grp").applyInPandas(fold, f"grp {kinds['grp']}, ord {kinds['ord']}, tokens bigint, request int")


def part_units(runs: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """(session, document, has_ts, first, last, bytes, opens): what a part is made of, whole. A unit is a window, or a
    record of a window that is larger than a hard cut allows; ``opens`` marks the first unit of each window."""
    window = [*KEYS, "line_start", "has_ts"]
    # the lines are read, ordered and matched once: what follows reads them several times, as numbers
    lines = runs.select(*window, "line_no", (F.octet_length("value") + 1).alias("size"), (is_record_start(F.col("value")) | (F.col("line_no") == F.col("line_start"))).alias("record"))
    lines = written(lines, "sizes")
    sizes = lines.groupBy(*window).agg(F.sum("size").alias("bytes"), F.max("line_no").alias("line_end"))
    hard = cfg.hard_part_factor * cfg.part_bytes
    small = sizes.where(~F.col("has_ts") | (F.col("bytes") <= hard)).select(*KEYS, "has_ts", F.col("line_start").alias("first"), F.col("line_end").alias("last"), "bytes", F.lit(True).alias("opens"))
    large = lines.join(sizes.where(F.col("has_ts") & (F.col("bytes") > hard)).select(*window), window)
    inside = Window.partitionBy(*window).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    records = large.withColumn("_record", F.count_if("record").over(inside)).groupBy(*window, "_record").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.sum("size").alias("bytes"))
    return small.unionByName(records.select(*KEYS, "has_ts", "first", "last", "bytes", (F.col("first") == F.col("line_start")).alias("opens")))


def parts_plan(runs: DataFrame, cfg: EngineConfig = EngineConfig(), size: int = 10_000) -> DataFrame:  # noqa: B008
    """(session, document, part, first line, last line, bytes) of processing parts.

    A part is cut at the next window start once it holds ``part_bytes``, at the next record start beyond
    ``hard_part_factor`` times that; files without timestamps every ``part_lines`` lines.

    Every unit first learns where a part that started with it would end: the next unit at or after a position, found over
    blocks of ``size`` units. The cuts are those that the first unit leads to; pointers that leap twice as far in each round reach
    them all in as many rounds as the number of parts has binary digits, and no file is folded in one place.
    """
    units = running_sum(part_units(runs, cfg), KEYS, ["first"], "bytes", "start", size)
    units = written(units.withColumn("start", F.col("start").cast("bigint")), "units")
    full = F.when(F.col("has_ts"), F.col("start") + cfg.part_bytes).otherwise(F.col("first") + cfg.part_lines)
    rows = units.withColumns({"_soft": full, "_hard": F.when(F.col("has_ts"), F.col("start") + cfg.hard_part_factor * cfg.part_bytes)})
    targets = units.select(*KEYS, "opens", F.when(F.col("has_ts"), F.col("start")).otherwise(F.col("first")).alias("pos"), "first", "has_ts")
    rows = next_at_or_after(rows, targets.where("opens or not has_ts"), KEYS, "_soft", "pos", "first", "_a", size)
    rows = next_at_or_after(rows.where("has_ts"), targets.where("has_ts"), KEYS, "_hard", "pos", "first", "_b", size).unionByName(rows.where("not has_ts").withColumn("_b", F.lit(None).cast("bigint")))
    leap = written(rows.select(*KEYS, "first", F.least("_a", "_b").alias("next")), "leaps")
    reached = units.groupBy(*KEYS).agg(F.min("first").alias("first"))
    while True:
        reached = written(reached, "cuts")
        far = same_keys(reached, leap.where("next is not null"), [*KEYS, "first"]).select(*KEYS, F.col("next").alias("first"))
        if far.isEmpty():
            break
        reached = reached.unionByName(far)
        onward = leap.select(*KEYS, F.col("first").alias("next"), F.col("next").alias("then"))
        leap = written(same_keys(leap.where("next is not null"), onward, [*KEYS, "next"]).select(*KEYS, "first", F.col("then").alias("next")), "leaps")
    ends = units.groupBy(*KEYS).agg(F.max("last").alias("_last"), F.sum("bytes").cast("bigint").alias("_bytes"))
    cuts = same_keys(same_keys(reached, units.select(*KEYS, "first", "start"), [*KEYS, "first"]), ends, KEYS)
    w = Window.partitionBy(*KEYS).orderBy("first")  # one row a part
    return cuts.select(
        *KEYS, (F.row_number().over(w) - 1).alias("part_idx"), F.col("first").alias("first_line"),
        F.coalesce(F.lead("first").over(w) - 1, "_last").alias("last_line"), (F.coalesce(F.lead("start").over(w), "_bytes") - F.col("start")).alias("bytes"),
    )


def stack_frames(runs: DataFrame) -> DataFrame:
    """(session_id, document_id, line_start, line_no, exception, frames): up to three frames of the first run of frames
    after each exception line of a window. Lines are read backwards, so that each carries only what follows it.
    """
    back = Window.partitionBy(*KEYS, "line_start").orderBy(F.desc("line_no"))
    frame = first_group(F.col("value"), (P.FRAME, 1))
    rows = runs.withColumn("_f", frame).withColumn("_f2", F.lag("_f", 1).over(back)).withColumn("_f3", F.when(F.col("_f2").isNotNull(), F.lag("_f", 2).over(back)))
    opens = F.when(F.col("_f").isNotNull(), F.struct("_f", "_f2", "_f3"))
    rows = rows.withColumn("_next", F.last(opens, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    hit = rows.withColumn("exception", first_group(F.col("value"), (P.EXCEPTION, 1))).where("exception is not null")
    frames = F.array_compact(F.array(F.col("_next._f"), F.col("_next._f2"), F.col("_next._f3")))
    return hit.select(*KEYS, "line_start", "line_no", "exception", frames.alias("frames"))
