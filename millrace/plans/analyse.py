"""From anomalous windows to findings, incidents, a report, and answers to questions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import findings, incidents, metrics, retrieval
from ..operators.ordered import number_lines
from ..operators.text_index import TextIndex
from ..ports import ChatModel, Embedder, embed_column, explain_column
from ..sources.scratch import written

NOTHING = "No anomalies were found in this session."
NO_EVIDENCE = "The logs hold nothing that answers this question."


def explain(windows: DataFrame, model: ChatModel, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """Findings of the anomalous windows (session_id, chunk_id, time_bucket, content, is_anomalous)."""
    replies = explain_column(windows.where("is_anomalous"), "content", "raw", model)
    f = findings.parse(replies.select("session_id", "chunk_id", "time_bucket", "line_start", "raw"))
    end = F.col("time_bucket") + F.expr(f"interval {cfg.window_seconds} seconds")
    return f.select("session_id", "category", "severity", "title", "explanation", "confidence", F.array("chunk_id").alias("evidence_chunk_ids"), F.col("time_bucket").alias("time_range_start"), end.alias("time_range_end"), F.col("line_start").alias("seq"))


def correlate(built: DataFrame, finding_rows: DataFrame, model: ChatModel, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """Incidents with narrative and root cause; a judge may ask for another attempt, the last is taken as it is."""
    listed = incidents.titles(built, finding_rows).groupBy("incident").agg(F.array_join(F.array_sort(F.collect_set("title")), "\n").alias("facts"))

    @F.pandas_udf("narrative string, root_cause string")
    def tell(facts: pd.Series) -> pd.DataFrame:
        rows = []
        for f in facts:
            out = {}
            for _ in range(cfg.correlate_attempts):
                out = json.loads(model.complete("correlate: narrative and root_cause as JSON", f or ""))
                if json.loads(model.complete("judge: grounded as JSON", f"{f}\n{out}")).get("grounded"):
                    break
            rows.append((out.get("narrative"), out.get("root_cause")))
        return pd.DataFrame(rows, columns=["narrative", "root_cause"])

    told = listed.withColumn("t", tell("facts")).select(F.col("incident").alias("id"), F.col("t.narrative").alias("narrative"), F.col("t.root_cause").alias("root_cause_hypothesis"))
    return built.join(told, "id", "left")


def condensed(texts: DataFrame, model: ChatModel, size: int) -> DataFrame:
    """(pos, text) in order: groups of ``size`` texts become one each, until no more than that are left."""

    @F.pandas_udf("string")
    def shorten(facts: pd.Series) -> pd.Series:
        return facts.map(lambda f: model.complete("report", f or ""))

    n = texts.count()
    while n > size:
        group = F.floor(F.col("pos") / size)
        lists = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
        texts = written(texts.groupBy(group.alias("pos")).agg(lists.alias("text")).select("pos", shorten("text").alias("text")), "condensed")
        n = texts.count()
    return texts


def report(spark: SparkSession, session_id: str, metric_rows: DataFrame, finding_rows: DataFrame, incident_rows: DataFrame, model: ChatModel, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """One row (session_id, generated_at, content_md, content_json).

    Every incident of the session counts and reaches the model, in groups where they are too many for a prompt; of the
    metrics only the top ones.
    """
    mine = lambda df: df.where(F.col("session_id") == session_id)
    n, told = mine(finding_rows).count(), mine(incident_rows).count()
    top = metrics.top_metrics(mine(metric_rows), cfg.top_metrics).collect()  # a bounded top-k
    if not n:
        md = NOTHING
    else:
        table = "\n".join(f"| {r.category} | {r.metric} | {r.total} |" for r in top[: cfg.report_rows])
        order = F.struct(F.col("time_range_start").isNull(), "time_range_start", "id")
        placed = number_lines(mine(incident_rows).withColumn("_o", order).withColumn("_b", F.coalesce(F.floor(F.unix_seconds("time_range_start") / 86400), F.lit((1 << 62) - 1))), ["session_id"], "_o", 1, "_n", block="_b")
        few = condensed(placed.select((F.col("_n") - 1).alias("pos"), F.concat(F.lit("- "), F.coalesce("narrative", F.lit(""))).alias("text")), model, cfg.report_rows)
        body = model.complete("report", "\n".join(r["text"] for r in few.orderBy("pos").collect()) or "-")  # at most report_rows
        md = f"{body}\n\n## Key Metrics\n\n| Category | Metric | Total |\n| --- | --- | --- |\n{table}"
    content = json.dumps({"finding_count": n, "incident_count": told, "metrics": [{"category": r.category, "metric": r.metric, "total": r.total} for r in top]})
    made = spark.createDataFrame([(session_id, md, content)], "session_id string, content_md string, content_json string")
    return made.withColumn("generated_at", F.current_timestamp())


@dataclass(frozen=True)
class Answer:
    text: str
    citations: list[str]


def drilldown(chunks: DataFrame, question: str, model: ChatModel, embedder: Embedder | None, cfg: EngineConfig = EngineConfig(), index: TextIndex | None = None) -> Answer:  # noqa: B008
    """Retrieve, grade, rewrite at most twice, answer; citations outside the evidence are dropped. With an ``index`` of the chunks no text is searched."""
    asked, best = question, []
    for attempt in range(cfg.max_rewrites + 1):
        vector = embedder.embed([asked])[0] if embedder else None
        hits = retrieval.retrieve(chunks, asked, vector, cfg.retrieve_limit, index=index)
        docs = hits.join(chunks, F.col("key") == chunks["chunk_id"]).orderBy(F.desc("score"), "key").select("chunk_id", F.substring("content", 1, 800).alias("content")).collect()  # at most the limit
        best = best or docs
        text = "\n".join(f"[{d.chunk_id}] {d.content}" for d in docs)
        useful = set(json.loads(model.complete("grade: useful ids as JSON", f"{asked}\n{text}")).get("useful", [])) if docs else set()
        graded = [d for d in docs if d.chunk_id in useful]
        if graded or attempt == cfg.max_rewrites:
            break
        asked = model.complete("rewrite", asked)
    use = graded or docs or best
    if not use:
        return Answer(NO_EVIDENCE, [])
    ids = {d.chunk_id for d in use}
    out = json.loads(model.complete("answer: answer and citations as JSON", question + "\n" + "\n".join(f"[{d.chunk_id}] {d.content}" for d in use)))
    return Answer(out.get("answer", ""), [c for c in out.get("citations", []) if c in ids])


_DOCS = "array<struct<chunk_id:string,content:string>>"


def _evidence(docs: list[dict]) -> str:
    return "\n".join(f"[{d['chunk_id']}] {d['content']}" for d in docs)


def drilldown_each(chunks: DataFrame, questions: DataFrame, model: ChatModel, embedder: Embedder, index: TextIndex, cfg: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """(question_id, question, answer, citations): :func:`drilldown` for every row (question_id, question), in one run.

    A round retrieves for all questions that are still open and grades what was found; what each question has been rewritten
    to, its first evidence and its useful evidence are columns of a table that every round writes anew. The model is
    called by the tasks that hold the questions.
    """

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                docs = r["docs"] or []
                ids = set(json.loads(model.complete("grade: useful ids as JSON", f"{r['asked']}\n{_evidence(docs)}")).get("useful", [])) if docs else set()
                useful = [d for d in docs if d["chunk_id"] in ids]
                last = r["attempt"] == cfg.max_rewrites
                over = bool(useful) or last
                out.append({"question_id": r["question_id"], "question": r["question"], "asked": r["asked"] if over else model.complete("rewrite", r["asked"]), "attempt": r["attempt"] + 1, "best": r["best"] or docs, "use": (useful or docs or r["best"] or []) if over else [], "over": over})
            yield from pa.Table.from_pylist(out, b_schema).to_batches()

    item = pa.list_(pa.struct([("chunk_id", pa.string()), ("content", pa.string())]))
    b_schema = pa.schema([("question_id", pa.string()), ("question", pa.string()), ("asked", pa.string()), ("attempt", pa.int32()), ("best", item), ("use", item), ("over", pa.bool_())])
    spark_schema = f"question_id string, question string, asked string, attempt int, best {_DOCS}, use {_DOCS}, over boolean"
    none = F.array().cast(_DOCS)
    open_ = written(questions.select(F.col("question_id").cast("string").alias("question_id"), "question", F.col("question").alias("asked"), F.lit(0).alias("attempt"), none.alias("best")), "questions")
    text = chunks.select(F.col("chunk_id").alias("key"), F.substring("content", 1, 800).alias("content"))
    closed = None
    for _ in range(cfg.max_rewrites + 1):
        asked = embed_column(open_.select(F.col("question_id").alias("query"), F.col("asked").alias("text")), "text", "embedding", embedder, cfg.embed_text_chars)
        hits = retrieval.retrieve_each(chunks, written(asked, "asked"), index, cfg.retrieve_limit)
        docs = hits.join(text, "key").groupBy(F.col("query").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("key").alias("chunk_id"), "content"))).alias("d"))
        docs = docs.select("question_id", F.transform("d", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["content"].alias("content"))).alias("docs"))  # at most the limit for each question
        state = written(open_.join(docs, "question_id", "left").mapInArrow(graded, spark_schema), "graded")
        done = state.where("over")
        closed = done if closed is None else closed.unionByName(done)
        open_ = state.where("not over").select("question_id", "question", "asked", "attempt", "best")
        if open_.isEmpty():
            break

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                ids = {d["chunk_id"] for d in r["use"]}
                reply = json.loads(model.complete("answer: answer and citations as JSON", r["question"] + "\n" + _evidence(r["use"]))) if ids else {"answer": NO_EVIDENCE}
                out.append({"question_id": r["question_id"], "question": r["question"], "answer": reply.get("answer", ""), "citations": [c for c in reply.get("citations", []) if c in ids]})
            yield from pa.Table.from_pylist(out, pa.schema([("question_id", pa.string()), ("question", pa.string()), ("answer", pa.string()), ("citations", pa.list_(pa.string()))])).to_batches()

    return closed.select("question_id", "question", "use").mapInArrow(answered, "question_id string, question string, answer string, citations array<string>")
