"""Points met with the time ranges that hold them, by bins as wide as the ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(at: Column, width: Column) -> Column:
    return F.call_function("div", at - F.pmod(at, width), width)


def interval_join(ranges: DataFrame, points: DataFrame, keys: Sequence[str], lo: str, hi: str, at: str, unit_seconds: int = 60, salts: int = 8) -> DataFrame:
    """Every pair of a range and a point of equal ``keys`` with lo <= at <= hi, once.

    A range gets the smallest bin width, ``unit_seconds`` times a power of two, that is no shorter than itself, so it
    lies in one or two bins; a point is in one bin of each width that occurs. Pairs meet by keys, width and bin, so a
    point meets few ranges that do not hold it, however many there are under one key. A bin's points are dealt over
    ``salts`` tasks, to which its ranges are copied. Ranges without a bound, or that end before they start, hold nothing.
    """
    unit = unit_seconds * 1_000_000
    a, b = F.unix_micros(lo), F.unix_micros(hi)
    r = ranges.withColumns({"_a": a, "_b": b}).where("_a <= _b")
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("_b") - F.col("_a"), F.lit(1)) / F.lit(unit)))).cast("int")
    r = r.withColumn("_level", level)
    width = lambda k: F.lit(unit).cast("bigint") * F.expr(f"shiftleft(1L, {k})")
    r = r.withColumn("_level", F.when(width("_level") < F.col("_b") - F.col("_a"), F.col("_level") + 1).otherwise(F.col("_level")))
    levels = sorted(x["_level"] for x in r.select("_level").distinct().collect())  # powers of two: some 40 at most
    w = width("_level")
    r = r.withColumn("_bin", F.explode(F.sequence(_bin(F.col("_a"), w), _bin(F.col("_b"), w)))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    p = points.withColumn("_at", F.unix_micros(at)).where("_at is not null").withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels] or [F.lit(-1)])))
    p = p.where("_level >= 0").withColumn("_bin", _bin(F.col("_at"), w)).withColumn("_salt", F.pmod(F.xxhash64("_at", *[F.col(f"`{c}`") for c in points.columns]), F.lit(salts)).cast("int"))
    met = r.join(p, [*keys, "_level", "_bin", "_salt"]).where("_at between _a and _b")
    return met.drop("_a", "_b", "_at", "_level", "_bin", "_salt")
