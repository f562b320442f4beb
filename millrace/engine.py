"""The façade: a folder of session-partitioned tables, and every read query on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import EngineConfig
from .operators import findings, incidents, metrics, windows
from .operators.text_index import TextIndex
from .plans import analyse
from .plans.ingest import ingest, session_metrics
from .ports import ChatModel, EchoModel, Embedder, HashEmbedder, embed_column
from .sources import tables
from .sources.lines import split_lines
from .sources.merge import MergeTable


class Engine:
    def __init__(self, spark: SparkSession, root: str, cfg: EngineConfig = EngineConfig(), model: ChatModel | None = None, embedder: Embedder | None = None):  # noqa: B008
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), cfg
        self.model, self.embedder = model or EchoModel(), embedder or HashEmbedder()
        self._chunks = MergeTable(spark, f"{self.root}/chunks", f"{schemas.CHUNKS}, version bigint", "chunk_id", "version")
        self._reports = MergeTable(spark, f"{self.root}/reports", schemas.REPORTS, "session_id", "generated_at")

    def _table(self, name: str, schema: str) -> DataFrame:
        return tables.read_or_empty(self.spark, f"{self.root}/{name}", schema)

    def ingest(self, path: str, session_id: str) -> None:
        """Replace a session's chunks and metrics by those of the files at ``path``; running it again changes nothing."""
        done = ingest(split_lines(self.spark, path, session_id), self.cfg, content=True)
        content = windows.with_chunk_id(done.table).select("chunk_id", "content")
        out = done.windows.join(content, "chunk_id")
        out = embed_column(out, "content", "embedding", self.embedder, self.cfg.embed_text_chars)
        self._chunks.drop(session_id)
        self._chunks.load(out.withColumn("created_at", F.current_timestamp()).withColumn("version", F.lit(0)))
        TextIndex.build(self.chunks().where(F.col("session_id") == session_id), self._index_path(session_id))
        tables.write_sessions(session_metrics(done.metrics, self.cfg), f"{self.root}/metrics")

    def _index_path(self, session_id: str) -> str:
        return f"{self.root}/text_index/session_id={session_id}"

    def store_embeddings(self, vectors: DataFrame, version: int, name: str | None = None) -> None:
        """Vectors of (session_id, chunk_ids, vectors) replace those of an earlier version; nothing else is rewritten."""
        pairs = tables.pair_vectors(vectors.select("session_id", "chunk_ids", "vectors"))
        self._chunks.change(pairs.select("session_id", "chunk_id", F.col("vector").alias("embedding"), F.lit(version).alias("version")), name)

    def backfill(self, session_id: str, version: int = 1) -> int:
        """Embed the session's chunks that have no vector; returns how many there were."""
        rows = tables.missing_embeddings(self.chunks().where(F.col("session_id") == session_id))
        n = rows.count()
        if n:
            found = embed_column(rows.select("session_id", "chunk_id", "content"), "content", "embedding", self.embedder, self.cfg.embed_text_chars)
            self._chunks.change(found.select("session_id", "chunk_id", "embedding", F.lit(version).alias("version")))
        return n

    def compact(self) -> None:
        """Fold changes of vectors and reports into their tables."""
        self._chunks.compact()
        self._reports.compact()

    def analyse(self, session_id: str) -> None:
        chunks = self.chunks().where(F.col("session_id") == session_id)
        found = findings.merge(analyse.explain(chunks, self.model, self.cfg)).withColumn("id", F.col("fingerprint"))
        tables.write_sessions(found, f"{self.root}/findings")
        found = self.findings_table().where(F.col("session_id") == session_id)
        built = incidents.incidents(incidents.cluster(found, self.cfg))
        tables.write_sessions(analyse.correlate(built, found, self.model, self.cfg), f"{self.root}/incidents")
        rep = analyse.report(self.spark, session_id, self.metrics_table(), found, self.incidents_table(), self.model, self.cfg)
        self._reports.change(rep)

    def chunks(self) -> DataFrame:
        return self._chunks.read().drop("version")

    def metrics_table(self) -> DataFrame:
        return self._table("metrics", schemas.METRICS)

    def findings_table(self) -> DataFrame:
        return self._table("findings", schemas.FINDINGS + ", seq bigint")

    def incidents_table(self) -> DataFrame:
        return self._table("incidents", schemas.INCIDENTS + ", category string, n_findings bigint")

    def metrics(self, session_id: str, **filters: str) -> DataFrame:
        return metrics.metrics_query(self.metrics_table(), session_id, **filters)

    def findings(self, session_id: str, **filters: str) -> DataFrame:
        return findings.ranked(self.findings_table(), session_id, **filters)

    def incidents(self, session_id: str) -> DataFrame:
        return self.incidents_table().where(F.col("session_id") == session_id).orderBy(F.col("time_range_start").asc_nulls_last(), "id")

    def report(self, session_id: str) -> DataFrame:
        return self._reports.read().where(F.col("session_id") == session_id).select("generated_at", "content_md")

    def drilldown(self, session_id: str, question: str) -> analyse.Answer:
        chunks = self.chunks().where(F.col("session_id") == session_id)
        answer = analyse.drilldown(chunks, question, self.model, self.embedder, self.cfg, TextIndex(self.spark, self._index_path(session_id)))
        row = self.spark.createDataFrame([(session_id, question, answer.text, answer.citations)], "session_id string, question string, answer string, citations array<string>")
        tables.append(row.withColumn("created_at", F.current_timestamp()).withColumn("id", F.expr("uuid()")), f"{self.root}/messages")
        return answer

    def history(self, session_id: str) -> DataFrame:
        return self._table("messages", schemas.MESSAGES).where(F.col("session_id") == session_id).orderBy("created_at", "id")

    def drop(self, session_id: str) -> None:
        """Delete a session everywhere."""
        self._chunks.drop(session_id)
        self._reports.drop(session_id)
        for name in ("metrics", "findings", "incidents", "messages", "text_index"):
            tables.drop_session(self.spark, f"{self.root}/{name}", session_id)
