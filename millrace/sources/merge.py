"""Keyed tables with small changes beside a large base: changes are appended, reads merge them, compaction folds them in.

A table is a folder: ``base``, partitioned by session, and one folder for each change, ``changes/<columns>/batch=<name>``,
which holds the key, a version, and only the columns that it sets. Of several values for a key and column the one
of the latest version counts, and of equal versions that of the batch whose name sorts last; a change without a row in the base is a new row if it sets
all columns, else it waits. An update of a few rows therefore writes those rows and no others.

A change written again under its name replaces itself. Compaction rewrites the sessions that have changes and then
deletes the changes it has folded in; if it stops between the two, they are merged again, to the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import remove, written
from .tables import read_or_empty, write_sessions


class MergeTable:
    """``schema`` names all columns; ``key`` identifies a row within a session, ``version`` is the column that orders writers."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, version: str, session: str = "session_id"):
        self.spark, self.path, self.key, self.version, self.session = spark, path.rstrip("/"), key, version, session
        self.ddl, self.schema = schema, StructType.fromDDL(schema)
        self.ids = list(dict.fromkeys([session, key]))
        self.rest = [f.name for f in self.schema if f.name not in [*self.ids, version]]

    def _cast(self, *columns: str) -> list[Column]:
        return [F.col(c).cast(self.schema[c].dataType).alias(c) for c in columns]

    def _folder(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self) -> list[tuple[str, list[str]]]:
        """(folder, columns) of every change."""
        p, fs = self._folder(f"{self.path}/changes")
        if not fs.exists(p):
            return []
        found = []
        for kind in fs.listStatus(p):
            for batch in fs.listStatus(kind.getPath()):
                if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(batch.getPath(), "_SUCCESS")):
                    found.append((batch.getPath().toString(), kind.getPath().getName().split("+")))
        return sorted(found, key=lambda x: (x[0].rsplit("/", 1)[1], x[0]))

    def base(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/base", self.ddl).select(*self.schema.names)

    def load(self, rows: DataFrame) -> None:
        """Replace the base rows of the sessions in ``rows``; earlier changes of later versions still count."""
        write_sessions(rows.select(*self._cast(*[f.name for f in self.schema])), f"{self.path}/base", self.session, self.key if self.key != self.session else None)

    def change(self, rows: DataFrame, name: str | None = None) -> str:
        """Append a change: ``rows`` has the ids, the version, and the columns to set. Returns the batch's name."""
        columns = sorted(c for c in rows.columns if c in self.rest)
        name = name or uuid.uuid4().hex
        rows.select(*self._cast(*self.ids, self.version, *columns)).write.mode("overwrite").parquet(f"{self.path}/changes/{'+'.join(columns) or '-'}/batch={name}")
        return name

    def _changes(self, batches: list[tuple[str, list[str]]]) -> DataFrame | None:
        """(ids, c): for each changed row a struct of (version, batch, value) for each column, the latest ones."""
        if not batches:
            return None
        every, kinds = None, {f.name: f.dataType.simpleString() for f in self.schema}
        for n, (folder, columns) in enumerate(batches):
            ddl = ", ".join(f"`{c}` {kinds[c]}" for c in [*self.ids, self.version, *(c for c in columns if c != "-")])
            rows = self.spark.read.schema(ddl).parquet(folder)
            at = lambda c: F.struct(F.col(self.version).alias("version"), F.lit(n).alias("batch"), F.col(c).alias("value"))  # noqa: B023, E731
            none = lambda c: F.lit(None).cast(f"struct<version:{kinds[self.version]},batch:int,value:{kinds[c]}>")
            rows = rows.select(*self.ids, self.version, *[(at(c) if c in columns else none(c)).alias(f"_{c}") for c in self.rest])
            every = rows if every is None else every.unionByName(rows)
        order = lambda c: F.when(F.col(f"_{c}").isNotNull(), F.struct(F.col(f"_{c}.version"), F.col(f"_{c}.batch")))
        return every.groupBy(*self.ids).agg(F.max(self.version).alias("_version"), *[F.max_by(F.col(f"_{c}"), order(c)).alias(f"_{c}") for c in self.rest])

    def read(self) -> DataFrame:
        """All rows with the latest value of each column."""
        return self._merged(self._batches())

    def _merged(self, batches: list[tuple[str, list[str]]]) -> DataFrame:
        base, changes = self.base(), self._changes(batches)
        if changes is None:
            return base
        both = base.withColumn("_there", F.lit(True)).join(changes, self.ids, "full")
        whole = F.lit(True)
        for c in self.rest:
            whole = whole & F.col(f"_{c}").isNotNull()
        newer = lambda c: F.col(f"_{c}").isNotNull() & (F.col("_there").isNull() | F.col(self.version).isNull() | (F.col(f"_{c}.version") >= F.col(self.version)))
        columns = {c: F.when(newer(c), F.col(f"_{c}.value")).otherwise(F.col(c)) for c in self.rest} | {self.version: F.greatest(F.col(self.version), F.col("_version"))}
        return both.where(F.col("_there") | whole).select(*[columns[f.name].alias(f.name) if f.name in columns else F.col(f.name) for f in self.schema])

    def compact(self) -> int:
        """Fold all changes into the base, rewriting only the sessions that they touch; returns how many were folded in."""
        batches = self._batches()
        changes = self._changes(batches)
        if changes is None:
            return 0
        touched = changes.select(self.session).distinct()
        # a row's one version stands for all of its columns from now on, so that of a column which was set earlier is lost
        merged = written(self._merged(batches).join(touched, self.session, "left_semi"), "compacted")
        write_sessions(merged, f"{self.path}/base", self.session, self.key if self.key != self.session else None)
        remove(merged)
        for folder, _ in batches:
            p, fs = self._folder(folder)
            fs.delete(p, True)
        return len(batches)

    def drop(self, session_id: str) -> None:
        """Delete a session: its base rows, and its rows of every change."""
        for folder, columns in self._batches():
            kinds = {f.name: f.dataType.simpleString() for f in self.schema}
            rows = self.spark.read.schema(", ".join(f"`{c}` {kinds[c]}" for c in [*self.ids, self.version, *(c for c in columns if c != "-")])).parquet(folder)
            if rows.where(F.col(self.session) == session_id).isEmpty():
                continue
            kept = written(rows.where(F.col(self.session) != session_id), "kept")
            kept.write.mode("overwrite").parquet(folder)
            remove(kept)
        p, fs = self._folder(f"{self.path}/base/{self.session}={session_id}")
        fs.delete(p, True)
