"""From raw documents to packed training sequences: five stages, each written and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. Nulls in any column, empty and very long texts, repeated rows, empty tables and further columns
pass through every stage as its operator defines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, language_id, minhash_dedup, mixing, packing
from millrace.llm.common import bounded_batches, held_out, read_table, remove, row_of, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language (null texts, texts without a letter); ``lang`` becomes the predicted language.

    Without a row to learn from, only those without a letter go and ``lang`` stays as it is.
    """
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    if not model:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    found = language_id.identify(docs.select(row_of(docs)), model, ["row"], within="row").where("lang_pred <> 'und'")
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays; rows that share an id share its fate."""
    out = minhash_dedup.near_duplicates(docs).where("doc_id is not null")
    gone = out.groupBy("doc_id").agg(F.max("kept").alias("stays")).where("not stays").select(F.col("doc_id").alias("_gone"))
    gone = written(gone, "near-gone")
    return docs.select(row_of(docs)).join(gone, F.col("row.doc_id") == F.col("_gone"), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rakes over source, the language that the first stage found, and learnt topics; draws documents by probability."""
    return mixing.mix_rows(docs).where("_drawn").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_batches(stage: Stage) -> Stage:
    """The stage with whole rows going to Python in small batches: with Spark's own an executor of 3 GB is not enough."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", _in_batches(identify_language)),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", _in_batches(drop_near_copies)),
    ("mixing", _in_batches(mix_sources)),
    ("packing", _in_batches(pack)),
]
#: The stages are iterative or learned, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if k:
            remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
