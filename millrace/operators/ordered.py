"""Ordered operators that do not put a whole file into one task.

A file's lines are cut into blocks of bounded size. What must be carried into a block is computed over one row
per block; the rest is a window within the block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def with_block(df: DataFrame, order: str, size: int, name: str = "_block") -> DataFrame:
    return df.withColumn(name, F.floor((F.col(order) - 1) / size))


def number_lines(df: DataFrame, keys: Sequence[str], order: str, size: int, out: str = "line_no", block: str | None = None) -> DataFrame:
    """Adds ``out``: the rows of ``keys`` counted from 1 in the order of ``order``, which may have gaps.

    ``block`` names a column that already cuts the rows into blocks that follow each other.
    """
    df = df.withColumn("_block", F.col(block)) if block else with_block(df, order, size)
    counts = df.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    numbered = df.withColumn("_k", F.row_number().over(inside)).join(offsets, [*keys, "_block"])
    return numbered.withColumn(out, (F.col("_before") + F.col("_k")).cast("long")).drop("_block", "_before", "_k")


def with_ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """A written table of the rows with ``_block``: blocks of at most ``size`` rows that follow each other in the order of
    ``keys`` and ``order``. Ranges of the order are dealt to tasks, so one key's rows may fill many blocks of many tasks."""
    by = [*keys, *order]
    ranges = written(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return ranges.withColumn("_block", F.shiftleft(F.col("_range").cast("bigint"), 40) + F.floor((place - 1) / size)).drop("_range")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, size: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before each one, null keys being equal; blocks of ``size`` rows."""
    rows = with_ordered_blocks(df, keys, order, size)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_s")).withColumn("_in", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return same_keys(rows, sums, [*keys, "_block"]).withColumn(out, F.col("_in") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_in", "_block")


def next_at_or_after(rows: DataFrame, targets: DataFrame, keys: Sequence[str], at: str, pos: str, value: str, out: str, size: int) -> DataFrame:
    """``rows`` with ``out``: ``value`` of the first target of the same keys whose ``pos`` is not before the row's ``at``, or null.

    Rows and targets lie on one line, cut into blocks; a window over one row per block tells each block the first target after it.
    """
    both = rows.withColumns({"_pos": F.col(at), "_kind": F.lit(0), "_value": F.lit(None).cast(targets.schema[value].dataType)})
    both = both.unionByName(targets.select(*keys, F.col(pos).alias("_pos"), F.lit(1).alias("_kind"), F.col(value).alias("_value")), allowMissingColumns=True)
    line = with_ordered_blocks(both, keys, ["_pos", "_kind", "_value"], size)
    # read backwards: a frame that ends at the row grows by a row, one that starts there is gone through for every row
    later = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    heads = line.groupBy(*keys, "_block").agg(F.min(F.when(F.col("_kind") == 1, F.struct("_pos", "_value")))["_value"].alias("_head"))
    heads = heads.withColumn("_next", F.last("_head", ignorenulls=True).over(later)).drop("_head")
    inside = Window.partitionBy(*keys, "_block").orderBy(F.desc("_pos"), F.desc("_kind"), F.desc("_value")).rowsBetween(Window.unboundedPreceding, 0)
    found = same_keys(line, heads, [*keys, "_block"]).withColumn(out, F.coalesce(F.last("_value", ignorenulls=True).over(inside), "_next"))
    return found.where("_kind = 0").select(*rows.columns, out)


def same_keys(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, null keys being equal."""
    named = table.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[c for c in table.columns if c not in keys])
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, on).drop(*[f"_k{i}" for i in range(len(keys))])


def running_count(df: DataFrame, keys: Sequence[str], order: str, flag: Column, out: str, size: int) -> DataFrame:
    """Adds ``out``: how many rows up to each one have the flag."""
    df = with_block(df.withColumn("_f", flag.cast("long")), order, size)
    sums = df.groupBy(*keys, "_block").agg(F.sum("_f").alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_block", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_in"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(before, [*keys, "_block"]).withColumn(out, F.col("_in") + F.sum("_f").over(inside)).drop("_f", "_block", "_in")
