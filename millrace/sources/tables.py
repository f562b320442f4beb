"""Sinks and keyed tables: Parquet folders partitioned by session, rewritten partition by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sessions(df: DataFrame, path: str, session: str = "session_id", spread_by: str | None = None) -> None:
    """Replace the sessions that ``df`` holds; all others stay. Sorted within files for min/max pruning."""
    order = [c for c in (session, "time_bucket", "line_start", "created_at", spread_by) if c in df.columns]
    # a session is dealt to several tasks by time, line or key, so a large one is not written by one
    spread = F.pmod(F.xxhash64(*order[1:2]), F.lit(16)) if len(order) > 1 else F.lit(0)
    df.withColumn("_part", spread).repartition(session, "_part").drop("_part").sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(session).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("session_id").parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def drop_session(spark: SparkSession, path: str, session_id: str) -> bool:
    """Delete a session's partition folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/session_id={session_id}")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def update_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``chunks`` with the vectors of (chunk_id, vector) in place of their embedding where there is one."""
    v = vectors.select("chunk_id", F.col("vector").alias("_vector"))
    return chunks.join(v, "chunk_id", "left").withColumn("embedding", F.coalesce("_vector", "embedding")).drop("_vector").select(*chunks.columns)


def missing_embeddings(chunks: DataFrame) -> DataFrame:
    return chunks.where("embedding is null")


def pair_vectors(ids: DataFrame) -> DataFrame:
    """(..., chunk_id, vector) from rows of (..., chunk_ids, vectors); as many as the shorter list has."""
    n = F.least(F.size("chunk_ids"), F.size("vectors"))
    pairs = F.arrays_zip(F.slice("chunk_ids", 1, n).alias("chunk_id"), F.slice("vectors", 1, n).alias("vector"))
    rest = [c for c in ids.columns if c not in ("chunk_ids", "vectors")]
    return ids.select(*rest, F.explode(pairs).alias("p")).select(*rest, F.col("p.chunk_id").alias("chunk_id"), F.col("p.vector").alias("vector"))


def unprocessed(parts: DataFrame, done: DataFrame) -> DataFrame:
    """Parts without a marker, each once: a redelivered part is not processed again."""
    return parts.dropDuplicates(["document_id", "part_idx"]).join(done.select("document_id", "part_idx"), ["document_id", "part_idx"], "left_anti")


def first_uploads(files: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first upload of each key."""
    rest = [c for c in files.columns if c not in key]
    first = files.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return first.select(*key, "_r.*").select(*files.columns)


def without_parent(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose parent is not being deleted."""
    return child.join(gone.select(key), key, "left_anti")


def access(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds result: GRANTED, NOT_FOUND or FORBIDDEN; a guest session (no owner) is open to everyone."""
    owner = sessions.select(F.col("id").alias("session_id"), F.col("user_id").alias("_owner"), F.lit(True).alias("_there"))
    result = F.when(F.col("_there").isNull(), "NOT_FOUND").when(F.col("_owner").isNull() | (F.col("_owner") == F.col("user_id")), "GRANTED").otherwise("FORBIDDEN")
    return requests.join(owner, "session_id", "left").withColumn("result", result).drop("_owner", "_there")
