"""The pipeline on a small corpus with odd rows: whole results, each stage's decisions in effect."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, text(int(rng.integers(20, 400))), "en", f"s{k % 4}", 1) for k in range(120)]
    near = rows[5][1].split()
    near[3] = "changed"
    rows += [(200, rows[0][1].replace(" ", " \t", 1), "en", "s0", 1), (201, " ".join(near), "en", "s1", 1), (202, None, None, None, None), (203, "!!! 123", "en", "s2", 1), rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit(1)).withColumn("score", F.lit(2.0))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").collect()) for n, d in seen.items()}
    assert ids["language_id"] == sorted(r[0] for r in rows if r[0] not in (202, 203))
    assert ids["exact_dedup"] == [*range(120), 201] and ids["near_dedup"] == list(range(120))
    assert set(ids["mixing"]) <= set(range(120)) and len(ids["mixing"]) > 60
    assert sorted(set(ids["packing"])) == ids["mixing"]
    assert all(seen[n].columns == df.columns for n, _ in corpus_pipeline.STAGES[:-1])
    assert seen["packing"].where("length > 1024").count() == 0
    total = seen["packing"].agg(F.sum("length")).first()[0]
    least = sum(len(re.findall(r"\S+", r.text)) for r in seen["mixing"].collect())
    assert total > least
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_is_carried_forward(spark, tmp_path):
    """The predicted language, not the table's, reaches the later stages."""
    rng = np.random.default_rng(4)
    langs = [["".join(rng.choice(list(a), 5)) for _ in range(200)] for a in ("abcdefgh", "stuvwxyz")]
    rows = [(k, " ".join(rng.choice(langs[k % 2], 60)), ("l0", "l1")[k % 2], "s", 1) for k in range(80)] + [(90, " ".join(rng.choice(langs[1], 60)), "l0", "s", 1), (91, " ".join(rng.choice(langs[0], 60)), None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, df, str(tmp_path)).collect()}
    assert out[90] == "l1" and out[91] == "l0" and all(out[k] == f"l{k % 2}" for k in range(80))


def test_any_column_names(spark, tmp_path):
    """Names of the table's own that the stages use themselves, and names with dots, pass through."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(200)]
    rows = [(k, " ".join(rng.choice(words, 50)), "en", f"s{k % 3}", 1) for k in range(40)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("a.b", "_gone", "_topic", "_tokens", "_source", "_lang", "_p", "row", "tag", "t", "score", "_id", "_sha", "piece"):
        df = df.withColumn(c, F.lit("x"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0 and (name == "packing" or docs.columns == before.columns and docs.where("`a.b` = 'x' and _gone = 'x' and row = 'x'").count() == docs.count())


def test_python_gets_small_batches(spark, tmp_path):
    """A stage hands whole rows to Python a few MB at a time, the text once; a smaller bound of the session's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = lambda n: spark.range(0, 20, 1, 1).select(F.col("id").alias("doc_id"), F.expr(f"repeat(concat('word', id, ' '), {n})").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    df, large = texts(10), texts(100_000)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["b"])

    try:
        for stage in (s for n, s in corpus_pipeline.STAGES if n != "exact_dedup"):
            spark.conf.set(name, before)
            stage(spark, df, str(tmp_path))
            assert large.mapInArrow(sizes, "b long").agg(F.max("b")).first()[0] < 8 << 20
            spark.conf.set(name, "1m")
            stage(spark, df, str(tmp_path))
            assert spark.conf.get(name) == "1m"
        plan = corpus_pipeline.identify_language(spark, df, str(tmp_path))._jdf.queryExecution().analyzed().toString()
        assert re.search(r"MapInArrow predict\(row#\d+\)", plan)
    finally:
        spark.conf.set(name, before)
