"""Helpers shared by the corpus operators: reading tables, scratch tables in the shared folder, the fold rule."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a temporary one, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """Cut the lineage: write a Parquet table to the shared folder and read it back; ``dictionary`` off where values hardly recur.

    A lost executor costs a task that rereads the table, never a recomputation of the chain.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written`, when nothing lazy reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Bytes of a record batch of whole rows on their way to Python; Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of about BATCH_BYTES; a smaller bound of the session's stays.

    A batch is held by the JVM's writer, by the Python worker, and by what is derived from it, at once in every task.
    The setting is read when a plan runs, so it stays set.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, str(BATCH_BYTES + 1)))
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def row_of(docs: DataFrame) -> Column:
    """All columns as one struct ``row``, so that names of the table's own meet no others; any name will do."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row")


def combined(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], limit: int = 4 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with its small record batches joined into some of about ``limit`` bytes: each batch costs as much as many rows."""

    def joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= limit:
                yield from joined(held)
                held, size = [], 0
        if held:
            yield from joined(held)

    return go


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def release(*tables: DataFrame) -> None:
    """Delete written tables that no plan will read again; plans that nothing refers to lose their shuffle files too."""
    for t in tables:
        remove(t)
    if tables:
        collect_plans(tables[0].sparkSession)


def collect_plans(spark: SparkSession) -> None:
    """Spark's cleaner drops shuffle files only once Python and the JVM have collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()
