"""Exact deduplication with a heavy-hitter split.

Spark's frequent-items aggregate (a Misra-Gries summary with merging, bounded
by ``tracked`` counters) names the digests that may be frequent.  Their true
counts and winners are then verified over all rows and broadcast: at most
``heavy`` of them, so a group with a third of all rows never meets in a task;
its copies are dropped map-side.  All other digests are shuffled as usual.

Defined cases: a null text counts as empty; an empty text is a text like any
other; a null doc_id is less than any other; of rows that also share the
largest doc_id, one stays; an empty table gives an empty table; other columns
of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.llm.base import ascii_lower, free_name, whole_text
from anamnesis.session import materialize

#: Digests broadcast at most, and counters of the summary that proposes them.
HEAVY = 1_000
TRACKED = 65_536


def text_digest(text: str = "text") -> Column:
    """Hex SHA-256 of the text with A-Z lower-cased."""
    return F.sha2(ascii_lower(whole_text(text)), 256)


def heavy_winners(rows: DataFrame, winner: Column, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """(digest, winner, group_size) of the frequent digests, counted over all rows; ``heavy`` rows at most."""
    top = rows.agg(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top"))
    proposed = top.select(F.explode("top.item").alias("digest"))
    counted = rows.join(F.broadcast(proposed), "digest").groupBy("digest").agg(winner.alias("winner"), F.count("*").alias("group_size"))
    return materialize(counted.filter("group_size > 1"), "heavy-digests")


def exact_groups(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    thin = docs.select("doc_id", text_digest().alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(thin, "digests")
    best = F.max(F.struct("doc_id", "row"))
    winners = heavy_winners(rows, best, heavy, tracked)
    hot = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    rest = rest.select("digest", "doc_id", "row", best.over(group).alias("winner"), F.count("*").over(group).alias("group_size"))
    return hot.select(rest.columns).unionByName(rest).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = docs.select("doc_id", text_digest().alias("digest"))
    winners = heavy_winners(rows, F.max("doc_id"), heavy, tracked)
    digest, winner, rank = (free_name(docs, c) for c in ("digest", "winner", "rank"))
    winners = winners.select(F.col("digest").alias(digest), F.col("winner").alias(winner))
    texts = docs.withColumn(digest, text_digest())
    hot = texts.join(F.broadcast(winners), digest).filter(F.col("doc_id").eqNullSafe(F.col(winner)))
    hot = hot.dropDuplicates([digest])
    rest = texts.join(F.broadcast(winners), digest, "left_anti")
    order = Window.partitionBy(digest).orderBy(F.col("doc_id").desc_nulls_last())
    rest = rest.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1)
    return hot.select(docs.columns).unionByName(rest.select(docs.columns))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON g.text_sha256 = d.text_sha256
"""
