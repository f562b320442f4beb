"""Exact percentiles of large groups: ranks are located by histograms, then read off the bracketing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a value that one histogram resolves.
BITS = 21


def exact_percentile(rows: DataFrame, keys: Sequence[str], units: Column, q: float, out: str, interpolate: bool = True, bits: int = BITS, width: int = 42) -> DataFrame:
    """(keys, out): the q-th percentile of the whole numbers ``units`` of each group, as a double; nulls don't count.

    Interpolated between neighbours, or the smallest value with at least q of the rows up to it. Rows are first added up
    by value; a histogram over the upper bits tells which of its cells holds a rank, and only that cell's values are
    looked at next. No group's values are gathered: what is ordered together are the cells of one histogram, at
    most 2 to the power ``bits`` of them, as running sums. ``width`` is how many bits the values have; wider ones only
    make the first histogram larger.
    """
    counts = rows.select(*keys, units.cast("bigint").alias("_p0")).where("_p0 is not null").groupBy(*keys, "_p0").agg(F.count(F.lit(1)).alias("_c"))
    depths = range(0, max(width, 1), bits)
    levels = [counts]
    for depth in depths[1:]:
        levels.append(levels[-1].groupBy(*keys, F.shiftright(F.col(f"_p{depth - bits}"), bits).alias(f"_p{depth}")).agg(F.sum("_c").alias("_c")))
    n = levels[-1].groupBy(*keys).agg(F.sum("_c").alias("_n"))
    at = F.lit(q) * (F.col("_n") - 1) if interpolate else F.greatest(F.ceil(F.lit(q) * F.col("_n")) - 1, F.lit(0))
    sides = F.array(F.struct(F.lit("lo").alias("side"), F.floor(at).alias("rank")), F.struct(F.lit("hi").alias("side"), F.ceil(at).alias("rank")))
    wanted = n.select(*keys, "_n", F.explode(sides).alias("_s")).select(*keys, "_n", F.col("_s.side").alias("_side"), F.col("_s.rank").cast("bigint").alias("_rank"))
    for depth, level in zip(reversed(depths), reversed(levels), strict=True):
        cell, parent = f"_p{depth}", f"_p{depth + bits}"
        if parent in wanted.columns:
            met = wanted.join(level.withColumn(parent, F.shiftright(F.col(cell), bits)), [*keys, parent])
        else:
            met = wanted.join(level, list(keys))
        upto = Window.partitionBy(*keys, "_side").orderBy(cell)
        met = met.withColumn("_to", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        here = (F.col("_to") > F.col("_rank")) & (F.col("_to") - F.col("_c") <= F.col("_rank"))
        wanted = met.where(here).select(*keys, "_n", "_side", (F.col("_rank") - F.col("_to") + F.col("_c")).alias("_rank"), cell)
    side = lambda s: F.max(F.when(F.col("_side") == s, F.col("_p0"))).cast("double")
    both = wanted.groupBy(*keys, "_n").agg(side("lo").alias("_lo"), side("hi").alias("_hi"))
    part = at - F.floor(at) if interpolate else F.lit(0.0)
    return both.select(*keys, ((1 - part) * F.col("_lo") + part * F.col("_hi")).alias(out))
