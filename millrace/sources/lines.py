"""Log lines: from text files, from streams of files or messages, and from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import number_lines

SESSIONS = 4
#: What lines of the synthetic log say beside their request, by the remainder of the event's number modulo NOTE_EVERY.
NOTE_EVERY = 101
NOTES = {
    0: " GC pause 12.5ms", 1: " HikariPool-1 - Connection is not available", 2: " query timeout after 30 s", 3: " SQLException ORA-00001", 4: " FATAL",
    5: " 403 Forbidden", 6: " memory usage high", 7: " thread-pool rejected", 8: " Started App in 3 s", 9: " shutting down", 10: " deployed release 7",
    11: " configuration reloaded, config refresh", 12: " health check failed", 13: " incoming request", 14: " bad credentials", 15: " jwt expired",
}


def split_lines(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """(session_id, document_id, block, seq, value): lines split on \\n, \\r\\n and \\r; block and seq order them in each file.

    A block is an input split, so a large file is not ordered in one task. Bad bytes become U+FFFD.
    """
    return spark.read.text(path).select(
        F.lit(session_id).alias("session_id"), F.col("_metadata.file_path").alias("document_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.make_valid_utf8("value").alias("value"),
    )


def read_lines(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """(session_id, document_id, line_no, value): the lines of :func:`split_lines`, numbered from 1 in each file."""
    lines = number_lines(split_lines(spark, path, session_id), ["session_id", "document_id"], "seq", 1, block="block")
    return lines.select("session_id", "document_id", "line_no", "value")


def object_stat(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of the files at ``path``; one row with size -1 when there is none."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([(path, -1)], "path string, size bigint")


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of (document_id, value) from text files that arrive at ``path``."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path).select(F.col("_metadata.file_path").alias("document_id"), "value")


def kafka_messages(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """A stream of JSON messages of a topic, from the earliest offset. Needs the connector's jar."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return from_messages(raw, schema)


def from_messages(raw: DataFrame, schema: str) -> DataFrame:
    """(key, the columns of ``schema``) of JSON messages (key, value)."""
    return raw.select(F.col("key").cast("string").alias("key"), F.from_json(F.col("value").cast("string"), schema).alias("m")).select("key", "m.*")


def as_messages(df: DataFrame, key: str, partition: str | None = None) -> DataFrame:
    """Rows as keyed JSON messages, for a Kafka sink."""
    cols = [F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[c for c in df.columns if c != partition])).alias("value")]
    return df.select(*cols, *([F.col(partition).cast("int").alias("partition")] if partition else []))


def synth_log_lines(events: DataFrame) -> DataFrame:
    """(session_id, document_id, value, event_id, seq): the event table rendered as log lines in the order of seq.

    Some lines lack a timestamp on purpose, some are frames of a stack, and every 97th event is forty times slower.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.floor("value").cast("bigint") * F.when(F.col("event_id") % 97 == 0, 40).otherwise(1)
    t, u = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("user_id").cast("string")
    vs, ks = v.cast("string"), k.cast("string")
    mod = lambda n: k % n == 0
    kind = F.col("event_type")
    view = F.concat(t, F.lit(" INFO GET "), F.when(mod(10), F.concat(F.lit("/feature/"), ks)).otherwise(F.concat(F.lit("/items/"), u)), F.lit(' HTTP/1.1" status=200 took='), vs, F.lit("ms"))
    click = F.concat(t, F.lit(" INFO POST /api/click/"), ks, F.when(mod(7), " status=503").otherwise(" status=404"), F.lit(" latency: "), vs, F.lit("ms"))
    click = F.when(mod(11), F.concat(F.lit("  at com.app.Svc"), (k % 3).cast("string"), F.lit(".call(Svc.java)"))).otherwise(click)
    purchase = F.concat(t, F.lit(" INFO "), F.when(mod(33), "deadlock detected ").otherwise(""), F.when(mod(20), "slow query ").otherwise("executing query "), F.lit("INSERT INTO orders took "), vs, F.lit(" ms"))
    signup = F.concat(t, F.lit(" WARN login failed 401 Unauthorized"), F.when(mod(5), " token has expired").otherwise(""))
    name = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (k % 3 + 1).cast("int"))
    error = F.concat(F.when(mod(17), "").otherwise(F.concat(t, F.lit(" "))), F.lit("ERROR java.lang."), name, F.lit("Exception: boom"), F.when(mod(25), " OutOfMemoryError heap space").otherwise(""))
    value = F.when(kind == "view", view).when(kind == "click", click).when(kind == "purchase", purchase).when(kind == "signup", signup).otherwise(error)
    notes = F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])
    value = F.concat(value, F.coalesce(F.element_at(notes, (F.col("event_id") % NOTE_EVERY).cast("int")), F.lit("")))
    session = (F.col("user_id") % SESSIONS).cast("string")
    return events.select("event_id", F.col("event_id").alias("seq"), session.alias("session_id"), F.concat(F.lit("doc-"), session).alias("document_id"), value.alias("value"))
