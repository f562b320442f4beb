"""The thin queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, host_rules, language_id, lm_scoring, minhash_dedup, mixing, packing, periodic_runs, pii, quality, source_audit, suffix_dedup
from .common import held_out, read_table, written


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    out = language_id.identify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.to_json("shares").alias("shares"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality; background: all others."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    good = read_table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.cross_entropy_difference(docs, good)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = written(quality.features(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    model = quality.train(feats.where(~held_out(F.col("doc_id"))), read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    out = quality.apply(feats, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", *[count(k) for k in pii.KINDS[:4]], F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_rows(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return out.select("row.doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").cast("long").alias("n_tokens"), F.col("_p").alias("p"), F.col("_drawn").alias("drawn"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read_table(spark, sf_dir, "documents"))


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text, by crc32 of its id, ends in a loop of its own words; a null id has no loop."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("bigint").alias("g"), F.when(h % 10 == 0, F.array_remove(F.split("text", host_rules.GAP), "")).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    loop = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda k: F.get(F.col("w"), F.col("a") + k % F.col("p")))
    looped = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), loop), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), looped).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(with_loops(read_table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rank = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(rank)
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.floor(1000 * best["length"] / -best["period"]).cast("bigint").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_pii": op9_pii,
    "op10_source_mixing": op10_source_mixing,
    "op11_host_rules": op11_host_rules,
    "op12_source_audit": op12_source_audit,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op5_exact_dedup": exact_dedup.ORACLE, "op11_host_rules": host_rules.ORACLE, "op12_source_audit": source_audit.ORACLE}
