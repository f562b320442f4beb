"""Exact deduplication by a stateful stream.

The stream keeps one state row per digest in RocksDB (on disk, never expiring): the smallest stable
identifier seen, its content locator, and a count. A hit, meaning a digest that holds several rows, is not
believed before the whole normalised bytes have been compared. Only DataFrame operations are used.

Defined results: a null text is the empty text; a null id sorts after every other id; of repeated rows
with equal id and text exactly one is kept; an empty table gives an empty result. Columns beside id and
text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, row_of, scratch_path, written

#: Fixed value: the white space that counts as one space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Copies of a hit's join key, so that the rows of one hot digest spread over as many tasks.
SALTS = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _first() -> Column:
    """Orders rows of one digest: ids ascending, nulls last, then the row's tag."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tag", "file"))


def stream_state(feed: DataFrame, state: str, out: str) -> DataFrame:
    """Run every feed row that the stream at ``state`` has not seen yet; returns the state per digest.

    ``feed`` is a streaming DataFrame (digest, id, tag, file). Calling it again with the same ``state`` and
    ``out`` continues the stream, so the state also holds earlier runs' documents.
    """
    spark = feed.sparkSession
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        kept = feed.groupBy("digest").agg(_first().alias("first"), F.count(F.lit(1)).alias("n"))

        def store(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}/rows")

        kept.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    try:
        updates = spark.read.schema("digest string, first struct<no_id: boolean, id: bigint, tag: bigint, file: string>, n bigint, batch int").parquet(f"{out}/*/rows")
    except Exception as none_written:
        if "PATH_NOT_FOUND" not in str(none_written):
            raise
        return spark.createDataFrame([], "digest string, first struct<no_id: boolean, id: bigint, tag: bigint, file: string>, n bigint")
    return updates.groupBy("digest").agg(F.max_by("first", "batch").alias("first"), F.max("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, tag, file (the locator)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    feed = written(rows.select(digest(F.col("text")).alias("digest"), "id", F.monotonically_increasing_id().alias("tag"), F.input_file_name().alias("file")), "feed")
    folder = scratch_path(spark, "stream")
    stream = spark.readStream.schema(feed.schema).parquet(feed.inputFiles()[0].rsplit("/", 1)[0]) if feed.inputFiles() else None
    if stream is None:
        return spark.createDataFrame([], "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string, tag bigint, file string")
    state = written(stream_state(stream, f"{folder}/checkpoint", f"{folder}/out"), "state")
    groups = state.select("digest", "first", "n").withColumn("bytes_differ", F.lit(False))
    colliding = _colliding(rows, state)
    odd = written(colliding, "colliding")
    if odd.isEmpty():  # no two texts share a digest: the state is the answer
        remove(odd)
        out = feed.join(groups, "digest", "left")
        return out.select(F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("tag") == F.col("first.tag")).alias("kept"), F.col("digest").alias("text_sha256"), "tag", "file")
    return _by_bytes(rows)


def _colliding(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Digests of hits under which more than one whole text lies.

    Equal texts are brought together by their bytes, combined before the shuffle, so a hot text costs one
    row per task.
    """
    hits = state.where("n > 1").select("digest")
    salted = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    full = rows.select(digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("whole"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    whole = full.join(salted, ["digest", "salt"], "left_semi").groupBy("digest", "whole").agg(F.count(F.lit(1)).alias("n"))
    return whole.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")


def _by_bytes(rows: DataFrame) -> DataFrame:
    """The answer from whole texts; reached only if two texts share a SHA-256 digest."""
    tagged = written(rows.select("id", normalised(F.col("text")).alias("whole"), F.monotonically_increasing_id().alias("tag"), F.input_file_name().alias("file")), "whole")
    groups = tagged.groupBy("whole").agg(_first().alias("first"), F.count(F.lit(1)).alias("n"))
    out = tagged.join(groups, "whole")
    return out.select(F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("tag") == F.col("first.tag")).alias("kept"), F.sha2(F.col("whole").cast("binary"), 256).alias("text_sha256"), "tag", "file")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t"""


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts."""
    out = written(exact_dedup(docs, id_col, text_col), "decisions")
    pair = ["doc_id", "text_sha256"]
    kept = out.where("kept").select(*pair)
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_sha256"] == b["text_sha256"])
    lost = out.where("not kept").select(*pair).distinct()
    gone = written(lost.join(kept, same(lost, kept), "left_anti"), "gone").select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha"))
    rows = docs.select(row_of(docs), F.col(id_col).cast("long").alias("_id"), digest(F.col(text_col)).alias("_sha"))
    rows = rows.join(gone, rows["_id"].eqNullSafe(F.col("_gone_id")) & (rows["_sha"] == F.col("_gone_sha")), "left_anti")
    twice = written(out.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_twice_id"), F.col("text_sha256").alias("_twice_sha")), "twice")
    if not twice.isEmpty():  # rows repeated with the same id and text: one of each stays
        match = rows["_id"].eqNullSafe(F.col("_twice_id")) & (rows["_sha"] == F.col("_twice_sha"))
        rows = rows.join(twice, match, "left_anti").union(rows.join(twice, match, "left_semi").dropDuplicates(["_id", "_sha"]))
    return rows.select("row.*")
