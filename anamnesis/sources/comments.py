"""Live comment and message payloads as tables, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default author name and message type.
UNKNOWN_AUTHOR = "Unknown"
DEFAULT_TYPE = "direct_send"


def _field(payload: Column, *paths: str) -> Column:
    """The first non-empty of several JSON paths."""
    return F.coalesce(*[F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths])


def poll_comments(payloads: DataFrame) -> DataFrame:
    """(comment_id, ts, user_name, icon, comment) of polled chat items.

    The comment is the plain text, else the text of a paid message, else ''.
    """
    p = F.col("payload")
    return payloads.select(
        F.get_json_object(p, "$.id").alias("comment_id"),
        "ts",
        F.get_json_object(p, "$.authorDetails.displayName").alias("user_name"),
        F.get_json_object(p, "$.authorDetails.profileImageUrl").alias("icon"),
        F.coalesce(
            _field(p, "$.snippet.textMessageDetails.messageText", "$.snippet.superChatDetails.userComment"), F.lit("")
        ).alias("comment"),
    )


def pushed_comments(payloads: DataFrame) -> DataFrame:
    """The same columns from pushed items, which name their fields in several ways.

    An item may sit under ``data``; one without id keeps a NULL id and is never
    taken for a repeat.
    """
    inner = F.coalesce(F.get_json_object("payload", "$.data"), F.col("payload"))
    return payloads.withColumn("_item", inner).select(
        _field(F.col("_item"), "$.id").alias("comment_id"),
        "ts",
        F.coalesce(
            _field(F.col("_item"), "$.nickname", "$.name", "$.author.name", "$.displayName"), F.lit(UNKNOWN_AUTHOR)
        ).alias("user_name"),
        F.coalesce(_field(F.col("_item"), "$.profileImage", "$.author.profileImage"), F.lit("")).alias("icon"),
        F.coalesce(_field(F.col("_item"), "$.comment", "$.message"), F.lit("")).alias("comment"),
    )


def client_posts(posts: DataFrame) -> DataFrame:
    """One row per posted message; posts without client or messages are dropped."""
    kept = posts.filter((F.length("client_id") > 0) & (F.size("messages") > 0))
    return kept.select(
        "client_id",
        "ts",
        F.coalesce("type", F.lit(DEFAULT_TYPE)).alias("type"),
        "system_prompt",
        F.posexplode("messages").alias("pos", "message"),
    )
