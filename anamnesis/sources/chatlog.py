"""Chat-log files: reading, writing, catalogue, restore and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File name pattern and the session of restored messages.
FILE_TIME = r"log_(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2})"
RESTORED_SESSION = "restored"
MESSAGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("userName", T.StringType()),
        T.StructField("thinking", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
    ]
)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Messages of ``log_*.json`` files that hold one JSON array each.

    A file that cannot be parsed, or holds no array of messages, counts as empty.
    Multimodal content arrives as its JSON text.
    """
    rows = (
        spark.read.schema(MESSAGE)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "log_*.json")
        .json(path)
    )
    named = rows.withColumn("file_name", F.col("_metadata.file_name"))
    return named.filter(F.col("role").isNotNull())


def write_lines(messages: DataFrame, path: str, overwrite: bool = False) -> None:
    """Append messages (with ``file_name``) to a log, or replace it.

    One JSON object a line: a session of any size splits over files and tasks.
    """
    messages.write.mode("overwrite" if overwrite else "append").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("file_name", T.StringType()), *MESSAGE.fields])
    return spark.read.schema(schema).json(path)


def created_at(file_name: Column) -> Column:
    """ISO time in a file name, its last two dashes turned back into colons."""
    stamp = F.regexp_extract(file_name, FILE_TIME, 1)
    iso = F.regexp_replace(stamp, r"-(\d{2})-(\d{2})$", ":$1:$2")
    return F.when(F.length(stamp) > 0, iso)


def catalogue(messages: DataFrame) -> DataFrame:
    """(file_name, created_at, message_count, has_embeddings) per log file."""
    return messages.groupBy("file_name").agg(
        created_at(F.first("file_name")).alias("created_at"),
        F.count("*").alias("message_count"),
        F.bool_or(F.col("embedding").isNotNull()).alias("has_embeddings"),
    )


def latest(messages: DataFrame) -> DataFrame:
    return messages.agg(F.max("file_name").alias("file_name"))


def restored(messages: DataFrame, as_of: Column) -> DataFrame:
    """User and assistant messages with text as memory records."""
    kept = messages.filter(F.col("role").isin("user", "assistant") & (F.length("content") > 0))
    return kept.select(
        "file_name",
        "turn",
        F.lit(RESTORED_SESSION).alias("session_id"),
        "role",
        "content",
        F.coalesce(F.try_to_timestamp(F.col("timestamp")), as_of).alias("at"),
        "embedding",
    )


def restore_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("file_name").agg(
        F.count("*").alias("restored_count"), F.count("embedding").alias("embedding_count")
    )


def export(messages: DataFrame, sessions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Session rows (created or touched) and message rows for a database export.

    ``sessions(title, created_at, updated_at)`` are the ones already exported.
    """
    files = messages.select(F.col("file_name").alias("title")).distinct()
    touched = files.join(sessions.select("title", "created_at"), "title", "left").select(
        "title", F.coalesce("created_at", as_of).alias("created_at"), as_of.alias("updated_at")
    )
    rows = messages.select(
        F.col("file_name").alias("title"),
        "turn",
        "role",
        "content",
        F.coalesce(F.try_to_timestamp(F.col("timestamp")), as_of).alias("created_at"),
    )
    return touched, rows
