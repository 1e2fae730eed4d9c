"""Spreading activation over the link graph along fixed two-step patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.operators.links import edges_topk
from anamnesis.operators.order import top
from anamnesis.session import materialize

# --- fixed values: link types of the two hops of each pattern
SEMANTIC_PATTERNS = [
    ("semantic", "semantic"),
    ("entity", "temporal"),
    ("semantic", "causes"),
    ("semantic", "caused_by"),
    ("entity", "semantic"),
]
TEMPORAL_PATTERNS = [
    ("temporal", "semantic"),
    ("temporal", "entity"),
]
# --- fixed values: share of mass kept per hop, smallest mass followed, fusion constants
KEPT = 0.15
MIN_MASS = 1e-6
RRF_K = 60
RESULT_LIMIT = 50
SEED_THRESHOLD = 0.5
SEED_LIMIT = 5
MASS_DIGITS = 12
# rows of a frontier whose edges one task unpacks, and the tasks of a shuffle at most
FRONTIER_PER_TASK, MOST_TASKS = 50_000, 10_000


def graph_seeds(found: DataFrame, threshold: float = SEED_THRESHOLD, limit: int = SEED_LIMIT) -> DataFrame:
    """(query_id, node, score): the best few sufficiently similar units."""
    close = found.filter(F.col("similarity") >= threshold)
    best = top(close, ["query_id"], [F.desc("similarity"), F.asc("unit_id")], limit)
    return best.select("query_id", F.col("unit_id").alias("node"), F.col("similarity").alias("score"))


def _start(seeds: DataFrame, patterns: list[tuple[str, str]], first_id: int) -> DataFrame:
    """Seed mass, summing to 1 per query, once for each pattern."""
    # SEED_LIMIT rows a query
    per_query = Window.partitionBy("query_id")
    total, n = F.sum("score").over(per_query), F.count("*").over(per_query)
    mass = F.when(total == 0, 1.0 / n).otherwise(F.col("score") / total)
    jobs = F.array(
        *[
            F.struct(F.lit(first_id + i).alias("pattern"), F.lit(a).alias("hop1"), F.lit(b).alias("hop2"))
            for i, (a, b) in enumerate(patterns)
        ]
    )
    return seeds.withColumn("mass", mass).select("query_id", "node", "mass", F.inline(jobs))


def _packed(edges: DataFrame) -> DataFrame:
    """(node, link_type, to_nodes, shares): the edges of a node and type in one row."""
    packed = edges.groupBy("node", "link_type").agg(F.collect_list(F.struct("to_node", "share")).alias("_edges"))
    return packed.select("node", "link_type", F.col("_edges.to_node").alias("to_nodes"), F.col("_edges.share").alias("shares"))


def _pushed(frontier: DataFrame, edges: DataFrame, hop: str) -> DataFrame:
    """The frontier's rows with the edges that their mass is pushed over; a node without edges loses its share."""
    pushed = frontier.filter(F.col("mass") >= MIN_MASS).withColumn("link_type", F.col(hop))
    return pushed.join(edges, ["node", "link_type"])


def _by_query(rows: DataFrame, frontier: DataFrame) -> DataFrame:
    """Rows dealt to tasks by query, FRONTIER_PER_TASK of the frontier each: what follows needs no other shuffle.

    Edges are still packed here; unpacked, they would be some twenty times as many rows to shuffle.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(min(MOST_TASKS, max(least, -(-frontier.count() // FRONTIER_PER_TASK))), "query_id")


def walk(seeds: DataFrame, links: DataFrame, temporal_seeds: DataFrame | None = None) -> DataFrame:
    """(query_id, pattern, node, score) after two hops of every pattern.

    Each node keeps KEPT of the mass it holds and pushes the rest over its
    heaviest edges; what is left on the frontier at the end is added.
    All queries and patterns share one join per hop; the ranked edges and the
    frontier are stored between the hops that use them twice.  The result is
    partitioned by query.
    """
    ranked = edges_topk(links).select(F.col("from_unit_id").alias("node"), "link_type", F.col("to_unit_id").alias("to_node"), "share")
    edges = materialize(_packed(ranked), "edges")
    start = _start(seeds, SEMANTIC_PATTERNS, 0)
    if temporal_seeds is not None:
        start = start.unionByName(_start(temporal_seeds, TEMPORAL_PATTERNS, len(SEMANTIC_PATTERNS)))
    start = materialize(start, "walk-start")
    arrived = F.sum((1 - KEPT) * F.col("mass") * F.col("share"))
    reached = F.inline(F.arrays_zip(F.col("to_nodes").alias("to_node"), F.col("shares").alias("share")))
    once = _by_query(_pushed(start, edges, "hop1").select("query_id", "pattern", "hop2", "mass", "to_nodes", "shares"), start)
    middle = once.select("query_id", "pattern", "hop2", "mass", reached).groupBy("query_id", "pattern", "hop2", F.col("to_node").alias("node"))
    middle = materialize(middle.agg(arrived.alias("mass")), "walk-middle")
    # what a node keeps goes along as one edge to itself
    kept = start.select("query_id", "pattern", "node", "mass").unionByName(middle.select("query_id", "pattern", "node", "mass"))
    held = kept.filter(F.col("mass") >= MIN_MASS).select(
        "query_id", "pattern", F.lit(True).alias("held"), "mass", F.array("node").alias("to_nodes"), F.array(F.lit(1.0)).alias("shares")
    )
    pushed = _pushed(middle, edges, "hop2").select("query_id", "pattern", F.lit(False).alias("held"), "mass", "to_nodes", "shares")
    rows = _by_query(held.unionByName(pushed), middle).select("query_id", "pattern", "held", "mass", reached)
    sums = rows.groupBy("query_id", "pattern", F.col("to_node").alias("node")).agg(
        F.sum(F.when(F.col("held"), KEPT * F.col("mass"))).alias("_held"),
        F.sum(F.when(~F.col("held"), (1 - KEPT) * F.col("mass") * F.col("share"))).alias("_rest"),
    )
    rest = F.when(F.col("_rest") >= MIN_MASS, F.col("_rest"))
    scored = sums.filter(F.col("_held").isNotNull() | rest.isNotNull())
    score = F.coalesce("_held", F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))
    return scored.select("query_id", "pattern", "node", F.round(score, MASS_DIGITS).alias("score"))


def fuse_patterns(scores: DataFrame, limit: int = RESULT_LIMIT) -> DataFrame:
    """(query_id, node, score, rn): sum over patterns of 1/(60 + rank), ranks from 1."""
    # A two-hop walk from SEED_LIMIT seeds over 20 edges reaches at most 2 105
    # nodes, which bounds the rows of one window.
    order = Window.partitionBy("query_id", "pattern").orderBy(F.desc("score"), F.asc("node"))
    ranked = scores.withColumn("rank", F.row_number().over(order))
    fused = ranked.groupBy("query_id", "node").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return top(fused, ["query_id"], [F.desc("score"), F.asc("node")], limit)


def graph_search(seeds: DataFrame, links: DataFrame, temporal_seeds: DataFrame | None = None) -> DataFrame:
    return fuse_patterns(walk(seeds, links, temporal_seeds))
