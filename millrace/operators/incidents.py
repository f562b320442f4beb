"""Incidents: findings of one category whose time ranges lie close together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import stable_id
from ..sources.scratch import written
from .ordered import same_keys, with_ordered_blocks


def cluster(findings: DataFrame, cfg: EngineConfig = EngineConfig(), key: str = "id", size: int = 10_000) -> DataFrame:  # noqa: B008
    """Adds island: the number of the finding's cluster within its session and category.

    A finding joins while its start is at most the gap after the latest end so far. A missing bound never
    overlaps: findings without a start are one cluster of their own (-1), and one without an end closes its
    cluster.

    The findings are cut into blocks of ``size`` in the order of time. One row per block tells the latest end and whether the
    last finding is without an end; windows over those rows carry both into each block, and then the number of
    clusters before it. What remains are windows within a block.
    """
    groups, order = ["session_id", "category"], ["time_range_start", key]
    findings = written(findings, "findings")  # what they come from is read once, not for each range, sample and missing bound
    dated = with_ordered_blocks(findings.where("time_range_start is not null"), groups, order, size)
    at = F.struct(*[F.col(c) for c in order])
    blocks = dated.groupBy(*groups, "_block").agg(F.max("time_range_end").alias("_end"), F.max_by(F.col("time_range_end").isNull(), at).alias("_open"))
    earlier = Window.partitionBy(*groups).orderBy("_block")
    carried = blocks.select(*groups, "_block", F.max("_end").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_latest_in"), F.lag("_open", 1, False).over(earlier).alias("_open_in"))
    inside = Window.partitionBy(*groups, "_block").orderBy(*order)
    rows = dated.withColumn("_latest", F.max("time_range_end").over(inside.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_open", F.lag(F.col("time_range_end").isNull()).over(inside))
    rows = same_keys(rows, carried, [*groups, "_block"])
    latest, open_before = F.greatest("_latest", "_latest_in"), F.coalesce("_open", "_open_in")
    gap = F.expr(f"interval {cfg.cluster_gap_seconds} seconds")
    new = latest.isNull() | open_before | F.col("time_range_end").isNull() | (F.col("time_range_start") > latest + gap)
    rows = written(rows.withColumn("_new", new.cast("int")).select(*findings.columns, "_block", "_new"), "clusters")
    sums = rows.groupBy(*groups, "_block").agg(F.sum("_new").alias("_n"))
    before = sums.select(*groups, "_block", F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = same_keys(rows, before, [*groups, "_block"])
    island = F.col("_before") + F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("island", island.cast("bigint")).select(*findings.columns, "island")
    return out.unionByName(findings.where("time_range_start is null").withColumn("island", F.lit(-1).cast("bigint")))


def incident_id() -> Column:
    return stable_id(F.col("session_id"), F.col("category"), F.col("island"))


def incidents(clustered: DataFrame, key: str = "id") -> DataFrame:
    """(id, session_id, category, island, time range, finding_ids, n_findings) of each cluster."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col("time_range_start"), F.col(key).alias("k")))), lambda x: x["k"])
    out = clustered.groupBy("session_id", "category", "island").agg(F.min("time_range_start").alias("time_range_start"), F.max("time_range_end").alias("time_range_end"), ids.alias("finding_ids"), F.count(F.lit(1)).alias("n_findings"))
    return out.withColumn("id", incident_id())


def titles(incident_rows: DataFrame, findings: DataFrame, key: str = "id") -> DataFrame:
    """(incident, finding_id, title): the id stands in for a title that isn't there."""
    return _titled(incident_rows.select(F.col("id").alias("incident"), F.explode("finding_ids").alias("finding_id")), findings, key)


def cluster_titles(clustered: DataFrame, findings: DataFrame, key: str = "id") -> DataFrame:
    """:func:`titles` of the incidents of :func:`cluster`, with (session_id, category, island), row by row: an incident's findings,
    which may be most of a session's, are not gathered for it."""
    return _titled(clustered.select(incident_id().alias("incident"), "session_id", "category", "island", F.col(key).alias("finding_id")), findings, key)


def _titled(flat: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    t = findings.select(F.col(key).alias("finding_id"), F.col("title").alias("_title"))
    return flat.join(t, "finding_id", "left").select(*flat.columns, F.coalesce("_title", F.col("finding_id").cast("string")).alias("title"))
