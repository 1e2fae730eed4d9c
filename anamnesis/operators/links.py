"""Edges between memory units: temporal, semantic and shared-entity links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.functions.dates import HOUR_US, LINK_WINDOW_HOURS, best_event_time, link_weight
from anamnesis.functions.vector import cosine
from anamnesis.operators.order import spread_out, time_block, top, with_running_sum
from anamnesis.operators.similarity import nearest
from anamnesis.session import materialize

# Fixed values of the link rules.
KINDS = ["temporal", "semantic", "entity"]
TEMPORAL_PER_UNIT = 10
SEMANTIC_PER_UNIT = 5
SEMANTIC_THRESHOLD = 0.7
ENTITY_PER_UNIT = 50
NO_ENTITY = -1
MIN_EDGE_WEIGHT = 0.1
EDGES_PER_TYPE = 20
SLICE_SECONDS = 60
# unit ids of one time that share a window
UNITS_PER_SLICE = 1 << 16
# units of one entity that meet its partners in one task, and entities that are dealt out over several
ENTITY_SLICE = 100_000
FREQUENT_ENTITIES = 1_000
# rows of one call that meet all rows of the call in one task
CALL_SLICE = 1_000


def _edge(frm: str, to: str, kind: str, weight: Column, entity: Column | None = None) -> list[Column]:
    return [
        F.col("bank_id"),
        F.col(frm).alias("from_unit_id"),
        F.col(to).alias("to_unit_id"),
        F.lit(kind).alias("link_type"),
        weight.alias("weight"),
        (entity if entity is not None else F.lit(None).cast("bigint")).alias("entity_id"),
    ]


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.withColumns({"from_unit_id": F.col("to_unit_id"), "to_unit_id": F.col("from_unit_id")})
    return edges.unionByName(back)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per (from, to, type, entity); repeats carry the same weight."""
    key = ["bank_id", "from_unit_id", "to_unit_id", "link_type", "entity_id"]
    return edges.groupBy(*key).agg(F.max("weight").alias("weight")).select(*key[:4], "weight", "entity_id")


def new_edges(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges not stored yet; a stored edge keeps its weight."""
    fresh = distinct_edges(edges).withColumn("_entity", F.coalesce("entity_id", F.lit(NO_ENTITY)))
    known = stored.select(
        "from_unit_id", "to_unit_id", "link_type", F.coalesce("entity_id", F.lit(NO_ENTITY)).alias("_entity")
    )
    return fresh.join(known, ["from_unit_id", "to_unit_id", "link_type", "_entity"], "left_anti").drop("_entity")


def _within_call(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Pairs (u, o) of different units stored by the same retain call.

    The rows of a large call are dealt out over slices, each of which meets the whole call.
    """
    keys = ["bank_id", "batch_id", *extra]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / CALL_SLICE).alias("_slices"))
    sized = rows.join(sizes, keys)
    slice_of = F.pmod(F.xxhash64("unit_id"), F.col("_slices"))
    left = sized.select(*keys, slice_of.alias("_slice"), *[F.col(c).alias(f"u_{c}") for c in _payload(rows, extra)])
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slices") - 1))
    right = sized.select(*keys, every.alias("_slice"), *[F.col(c).alias(f"o_{c}") for c in _payload(rows, extra)])
    return left.join(right, [*keys, "_slice"]).drop("_slice").filter("u_unit_id <> o_unit_id")


def _payload(rows: DataFrame, extra: list[str]) -> list[str]:
    return [c for c in rows.columns if c not in ("bank_id", "batch_id", *extra)]


def temporal_links(units: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Links within 24 hours: the newest ten units of other calls, and all of the own call.

    ``units`` get links; candidates are ``stored`` (default: all of ``units``).
    The newest candidates at or before "24 hours after me" have consecutive
    positions in the bank's time order, so a running count finds them by an
    equi join on the position instead of a range join.
    """
    when = best_event_time(F.col("event_date"), F.col("occurred_start"), F.col("mentioned_at"))

    def timed(df: DataFrame) -> DataFrame:
        return df.select("bank_id", "batch_id", "unit_id", when.alias("at")).filter(F.col("at").isNotNull())

    mine = timed(units)
    pool = mine if stored is None else timed(stored)
    window = F.expr(f"interval {LINK_WINDOW_HOURS} hours")
    marks = pool.select("bank_id", "batch_id", "unit_id", "at", F.lit(0).alias("side")).unionByName(
        mine.select("bank_id", "batch_id", "unit_id", (F.col("at") + window).alias("at"), F.lit(1).alias("side"))
    )
    placed = with_running_sum(
        marks,
        ["bank_id"],
        ["at", "side", "unit_id"],
        time_block("at", SLICE_SECONDS),
        F.when(F.col("side") == 0, 1).otherwise(0),
        "pos",
        # a bank may have any number of units of one time
        [F.col("at"), F.col("side"), F.floor(F.col("unit_id") / UNITS_PER_SLICE)],
    )
    candidates = placed.filter("side = 0").select(
        "bank_id", "pos", F.col("unit_id").alias("o_unit_id"), F.col("batch_id").alias("o_batch_id"), F.col("at").alias("o_at")
    )
    own = pool.groupBy("bank_id", "batch_id").agg(F.count("*").alias("_own"))
    reach = F.sequence(F.col("pos"), F.greatest(F.lit(1), F.col("pos") - TEMPORAL_PER_UNIT - F.col("_own") + 1), F.lit(-1))
    probes = (
        placed.filter("side = 1 and pos > 0")
        .withColumn("at", F.col("at") - window)
        .join(own, ["bank_id", "batch_id"], "left")
        .na.fill(0, ["_own"])
        .withColumn("pos", F.explode(reach))
        .drop("side", "_own")
    )
    close = F.abs(F.unix_micros("at") - F.unix_micros("o_at")) <= LINK_WINDOW_HOURS * HOUR_US
    near = probes.join(candidates, ["bank_id", "pos"]).filter(
        (F.col("batch_id") != F.col("o_batch_id")) & (F.col("unit_id") != F.col("o_unit_id")) & close
    )
    newest = top(near, ["bank_id", "unit_id"], [F.desc("o_at"), F.desc("o_unit_id")], TEMPORAL_PER_UNIT)
    weight = F.round(link_weight(F.col("at"), F.col("o_at")), 13)
    across = both_ways(newest.select(*_edge("unit_id", "o_unit_id", "temporal", weight)))
    call = _within_call(mine, []).filter(
        F.abs(F.unix_micros("u_at") - F.unix_micros("o_at")) <= LINK_WINDOW_HOURS * HOUR_US
    )
    inside = call.select(
        *_edge("u_unit_id", "o_unit_id", "temporal", F.round(link_weight(F.col("u_at"), F.col("o_at")), 13))
    )
    return distinct_edges(across.unionByName(inside))


def semantic_links(
    units: DataFrame, stored: DataFrame | None = None, threshold: float = SEMANTIC_THRESHOLD
) -> DataFrame:
    """Links to the five most similar units, and to all similar units of the own call."""
    probes = units.withColumnRenamed("unit_id", "u_unit_id")
    pool = (units if stored is None else stored).withColumnRenamed("unit_id", "o_unit_id")
    banks = units.select("bank_id", F.col("unit_id").alias("u_unit_id"))
    found = nearest(
        probes, pool, threshold, SEMANTIC_PER_UNIT, query_id="u_unit_id", unit_id="o_unit_id", exclude_self=True
    ).join(banks, "u_unit_id")
    across = both_ways(found.select(*_edge("u_unit_id", "o_unit_id", "semantic", F.col("similarity"))))
    call = _within_call(units.select("bank_id", "batch_id", "unit_id", "embedding"), [])
    alike = call.withColumn("similarity", cosine(F.col("u_embedding"), F.col("o_embedding"))).filter(
        F.col("similarity") >= threshold
    )
    inside = alike.select(*_edge("u_unit_id", "o_unit_id", "semantic", F.col("similarity")))
    return distinct_edges(across.unionByName(inside))


def entity_links(units: DataFrame, unit_entities: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Links through each shared entity to its newest 50 units of other calls and to the own call."""
    cols = ["bank_id", "batch_id", "unit_id", "created_at"]
    mine = unit_entities.join(units.select(*cols), "unit_id")
    if stored is not None:
        return _ranked_links(mine, unit_entities.join(stored.select(*cols), "unit_id"))
    # Units of an entity with so few, all of one bank, are all linked with each other: no unit has more partners than
    # count.  Their edges come whole out of one join, without ranks and without pairs that both sides name.
    mine = materialize(mine, "named-units")
    sizes = mine.groupBy("entity_id").agg(F.count("*").alias("_n"), F.count("batch_id").alias("_calls"), F.count("bank_id").alias("_banked"), F.min("bank_id").alias("_low"), F.max("bank_id").alias("_high"))
    few = sizes.select("entity_id", (F.expr("_n <= {0} AND _calls = _n AND _banked = _n AND _low = _high".format(ENTITY_PER_UNIT + 1))).alias("_few"))
    sized = mine.join(few, "entity_id")
    rare = sized.filter("_few").select("entity_id", "bank_id", "unit_id").dropDuplicates(["entity_id", "unit_id"])
    met = rare.join(rare.select("entity_id", F.col("unit_id").alias("o_unit_id")), "entity_id").filter("unit_id <> o_unit_id")
    edges = met.select(*_edge("unit_id", "o_unit_id", "entity", F.lit(1.0), F.col("entity_id")))
    often = sized.filter("_few IS NULL OR NOT _few").drop("_few")
    return edges.unionByName(_ranked_links(often, often))


def _ranked_links(mine: DataFrame, pool: DataFrame) -> DataFrame:
    """Links of ``mine`` through each shared entity, whatever its size, to its newest units in ``pool`` and to the own call."""
    # Units are ranked before they are paired, so an entity of any size offers a fixed number of partners.  A call
    # can give another one its newest ENTITY_PER_UNIT units at most; of twice as many of these, at most half are a
    # unit's own call's, and the others hold its newest partners.
    per_call = top(
        pool, ["entity_id", "bank_id", "batch_id"], [F.desc("created_at"), F.desc("unit_id")], ENTITY_PER_UNIT, "place"
    ).drop("place")
    newest = top(per_call, ["entity_id"], [F.desc("created_at"), F.desc("unit_id")], 2 * ENTITY_PER_UNIT, "place")
    partner = F.struct("place", F.col("unit_id").alias("o_unit_id"), F.col("bank_id").alias("o_bank_id"), F.col("batch_id").alias("o_batch_id"))
    offered = newest.groupBy("entity_id").agg(F.sort_array(F.collect_list(partner)).alias("offered"))
    # the units of a frequent entity are dealt out over slices, each of which meets its one row of partners
    n = mine.groupBy("entity_id").agg(F.ceil(F.count("*") / ENTITY_SLICE).cast("int").alias("_slices"))
    frequent = F.broadcast(n.filter("_slices > 1").orderBy(F.desc("_slices"), "entity_id").limit(FREQUENT_ENTITIES))
    slices = F.coalesce("_slices", F.lit(1))
    dealt = mine.join(frequent, "entity_id", "left").withColumn("_slice", F.pmod(F.xxhash64("unit_id"), slices).cast("int"))
    offered = offered.join(frequent, "entity_id", "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    # few bytes become many pairs here
    dealt = spread_out(dealt.drop("_slices"), "entity_id", "_slice")
    met = dealt.join(offered.drop("_slices"), ["entity_id", "_slice"])
    other = lambda o: ~((o["o_batch_id"] == F.col("batch_id")) & (o["o_bank_id"] == F.col("bank_id"))) & (o["o_unit_id"] != F.col("unit_id"))
    chosen = F.slice(F.filter("offered", other), 1, ENTITY_PER_UNIT)
    across = met.select("bank_id", "entity_id", "unit_id", F.explode(F.transform(chosen, lambda o: o["o_unit_id"])).alias("o_unit_id"))
    inside = _within_call(mine, ["entity_id"]).filter("u_unit_id < o_unit_id")
    inside = inside.select("bank_id", "entity_id", F.col("u_unit_id").alias("unit_id"), "o_unit_id")
    # a pair that both sides name is one pair; it becomes two edges at the end
    pairs = across.unionByName(inside).select("bank_id", "entity_id", F.least("unit_id", "o_unit_id").alias("_a"), F.greatest("unit_id", "o_unit_id").alias("_b"))
    return both_ways(pairs.distinct().select(*_edge("_a", "_b", "entity", F.lit(1.0), F.col("entity_id"))))


def build_links(
    units: DataFrame,
    unit_entities: DataFrame,
    stored: DataFrame | None = None,
    threshold: float = SEMANTIC_THRESHOLD,
) -> DataFrame:
    """All three kinds of links of ``units``."""
    return (
        temporal_links(units, stored)
        .unionByName(semantic_links(units, stored, threshold))
        .unionByName(entity_links(units, unit_entities, stored))
    )


def link_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("bank_id", "link_type").agg(F.count("*").alias("links"))


def edges_topk(links: DataFrame, k: int = EDGES_PER_TYPE) -> DataFrame:
    """(bank_id, from, link_type, to, weight, share): the k heaviest edges per node and type.

    ``share`` is the weight divided by the node's total over the kept edges.
    """
    strong = links.filter(F.col("weight") >= MIN_EDGE_WEIGHT)
    kept = top(strong, ["bank_id", "from_unit_id", "link_type"], [F.desc("weight"), F.asc("to_unit_id"), F.asc_nulls_first("entity_id")], k)
    total = F.sum("weight").over(Window.partitionBy("bank_id", "from_unit_id", "link_type"))
    return kept.withColumn("share", F.col("weight") / total)
