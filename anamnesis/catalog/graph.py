"""Queries over links, the graph walk and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis.catalog import query
from anamnesis.catalog.fixtures import LINK_THRESHOLD, Tables, add_view, as_of
from anamnesis.catalog.search import ranked_sql
from anamnesis.operators import entities, links, search, walk

EDGE_COLUMNS = "bank_id, from_unit_id, to_unit_id, link_type, weight, entity_id"


@query("temporal_links", f"select {EDGE_COLUMNS} from fx_temporal_links", ("fx_temporal_links",))
def _temporal_links(t: Tables):
    return links.temporal_links(t.units)


@query("semantic_links", f"select {EDGE_COLUMNS} from fx_semantic_links", ("fx_semantic_links",))
def _semantic_links(t: Tables):
    return links.semantic_links(t.units, threshold=LINK_THRESHOLD)


@query("entity_links", f"select {EDGE_COLUMNS} from fx_entity_links", ("fx_entity_links",))
def _entity_links(t: Tables):
    return links.entity_links(t.units, t.unit_entities)


@query(
    "temporal_links_events",
    """with e as (select user_id as bank_id, event_id // 7 as batch_id, event_id as unit_id, ts as at from events)
select distinct bank_id, unnest([u, o]) as from_unit_id, unnest([o, u]) as to_unit_id, round(greatest(0.3, 1 - gap / 3600e6 / 24), 13) as weight
from (select a.bank_id, a.unit_id as u, b.unit_id as o, abs(epoch_us(a.at) - epoch_us(b.at)) as gap, a.batch_id = b.batch_id as own,
 row_number() over (partition by a.unit_id, a.batch_id = b.batch_id order by b.at desc, b.unit_id desc) as rn
 from e a join e b on a.bank_id = b.bank_id and a.unit_id <> b.unit_id and abs(epoch_us(a.at) - epoch_us(b.at)) <= 86400000000)
where own or rn <= 10""",
)
def _temporal_links_events(t: Tables):
    """The same rule on the whole event table, one bank per user."""
    none = F.lit(None).cast("timestamp")
    units = t.events.select(
        F.col("user_id").alias("bank_id"),
        F.floor(F.col("event_id") / 7).cast("bigint").alias("batch_id"),
        F.col("event_id").alias("unit_id"),
        F.col("ts").alias("event_date"),
        none.alias("occurred_start"),
        none.alias("mentioned_at"),
    )
    return links.temporal_links(units).drop("link_type", "entity_id")


@query(
    "build_links",
    "select bank_id, link_type, count(*) as links from fx_links where link_type not like 'cause%' group by all",
    ("fx_links",),
)
def _build_links(t: Tables):
    return links.link_counts(links.build_links(t.units, t.unit_entities, threshold=LINK_THRESHOLD))


@query(
    "edges_insert",
    """select bank_id, from_unit_id, to_unit_id, link_type, weight, entity_id from fx_links
where link_type <> 'causes' and link_type <> 'caused_by' and from_unit_id // 25 <> to_unit_id // 25""",
    ("fx_links",),
)
def _edges_insert(t: Tables):
    """Edges still to be stored when the ones inside a call already are."""
    inside = F.floor(F.col("from_unit_id") / 25) == F.floor(F.col("to_unit_id") / 25)
    stored = t.links.filter(inside)
    fresh = t.links.filter(~F.col("link_type").startswith("cause"))
    return links.new_edges(fresh.unionByName(fresh), stored)


add_view(
    "fx_edges",
    """select *, weight / sum(weight) over (partition by bank_id, from_unit_id, link_type) as share from (
 select *, row_number() over (partition by bank_id, from_unit_id, link_type order by weight desc, to_unit_id, entity_id nulls first) as rn
 from fx_links where weight >= 0.1) where rn <= 20""",
    "fx_links",
)


@query(
    "edges_topk",
    "select bank_id, from_unit_id, to_unit_id, link_type, weight, entity_id, rn, round(share, 9) as share from fx_edges",
    ("fx_edges",),
)
def _edges_topk(t: Tables):
    kept = links.edges_topk(t.links)
    return kept.withColumns({"share": F.round("share", 9), "rn": F.col("rn").cast("bigint")})


add_view(
    "fx_semantic_hits",
    ranked_sql("fx_probes", "fx_units", "unit_id", 0.1, 34, per="fact_type"),
    "fx_probes",
    "fx_units",
)
SEEDS_SQL = """select query_id, unit_id as node, similarity as score from {}
where similarity >= {} qualify row_number() over (partition by query_id order by similarity desc, unit_id) <= 5"""
add_view("fx_seeds", SEEDS_SQL.format("fx_semantic_hits", LINK_THRESHOLD), "fx_semantic_hits")


def _patterns_sql(patterns: list[tuple[str, str]], first: int) -> str:
    rows = ", ".join(f"({first + i}, '{a}', '{b}')" for i, (a, b) in enumerate(patterns))
    return f"(values {rows}) p(pattern, hop1, hop2)"


def walk_sql(start: str) -> str:
    return f"""with start as ({start}),
middle as (select s.query_id, s.pattern, s.hop2, e.to_unit_id as node, sum(0.85 * s.mass * e.share) as mass
 from start s join fx_edges e on e.from_unit_id = s.node and e.link_type = s.hop1 where s.mass >= 1e-6 group by all),
finish as (select s.query_id, s.pattern, e.to_unit_id as node, sum(0.85 * s.mass * e.share) as mass
 from middle s join fx_edges e on e.from_unit_id = s.node and e.link_type = s.hop2 where s.mass >= 1e-6 group by all)
select query_id, pattern, node, round(sum(mass), 12) as score from (
 select query_id, pattern, node, 0.15 * mass as mass from start where mass >= 1e-6
 union all select query_id, pattern, node, 0.15 * mass from middle where mass >= 1e-6
 union all select query_id, pattern, node, mass from finish where mass >= 1e-6) group by all"""


def start_sql(seeds: str, patterns: list[tuple[str, str]], first: int) -> str:
    return f"""select s.query_id, s.node, case when sum(s.score) over w = 0 then 1.0 / count(*) over w else s.score / sum(s.score) over w end as mass, p.pattern, p.hop1, p.hop2
from {seeds} s cross join {_patterns_sql(patterns, first)} window w as (partition by s.query_id, p.pattern)"""


FUSE_SQL = """select query_id, node, round(sum(1.0 / (60 + rank)), 9) as score, row_number() over (partition by query_id
 order by round(sum(1.0 / (60 + rank)), 9) desc, node) as rn from (
 select *, row_number() over (partition by query_id, pattern order by score desc, node) as rank from {})
group by query_id, node qualify rn <= 50"""
add_view("fx_walk", walk_sql(start_sql("fx_seeds", walk.SEMANTIC_PATTERNS, 0)), "fx_seeds", "fx_edges")
add_view(
    "fx_walk_all",
    walk_sql(
        start_sql("fx_seeds", walk.SEMANTIC_PATTERNS, 0)
        + " union all "
        + start_sql("(select query_id, unit_id as node, score from fx_entries)", walk.TEMPORAL_PATTERNS, 5)
    ),
    "fx_seeds",
    "fx_edges",
    "fx_entries",
)


def _seeds(t: Tables):
    return walk.graph_seeds(search.semantic_search(t.probes, t.units), LINK_THRESHOLD)


@query("graph_seeds", "select * from fx_seeds", ("fx_seeds",))
def _graph_seeds(t: Tables):
    return _seeds(t)


@query("meta_path_push", "select * from fx_walk", ("fx_walk",))
def _meta_path_push(t: Tables):
    return walk.walk(_seeds(t), t.links)


@query("meta_path_push_temporal", "select * from fx_walk_all", ("fx_walk_all",))
def _meta_path_push_temporal(t: Tables):
    from anamnesis.operators.temporal import entry_points

    entries = entry_points(t.probes, t.units).withColumnRenamed("unit_id", "node")
    return walk.walk(_seeds(t), t.links, entries)


@query("graph_rrf", FUSE_SQL.format("fx_walk"), ("fx_walk",))
def _graph_rrf(t: Tables):
    return walk.graph_search(_seeds(t), t.links).withColumn("rn", F.col("rn").cast("bigint"))


LINES_SQL = "select distinct l_orderkey as unit_id, l_suppkey as entity_id from lineitem"


def _order_suppliers(t: Tables):
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_suppkey").alias("entity_id"))
    return lines.repartition(entities.tasks_for(lines.count()), "unit_id").distinct()


@query("entity_pairs", f"""with ue as ({LINES_SQL})
select a.unit_id, a.entity_id as entity_id_1, b.entity_id as entity_id_2 from ue a join ue b on a.unit_id = b.unit_id and a.entity_id < b.entity_id""")
def _entity_pairs(t: Tables):
    return entities.entity_pairs(_order_suppliers(t))


@query(
    "cooccurrence",
    f"""with ue as ({LINES_SQL})
select a.unit_id % 5 as bank_id, a.entity_id as entity_id_1, b.entity_id as entity_id_2, count(distinct a.unit_id // 25) as cooccurrence_count,
 max(a.unit_id // 25) as last_call
from ue a join ue b on a.unit_id = b.unit_id and a.entity_id < b.entity_id group by all""",
)
def _cooccurrence(t: Tables):
    call = F.floor(F.col("unit_id") / 25).cast("bigint")
    rows = _order_suppliers(t).select(
        "unit_id", "entity_id", (F.col("unit_id") % 5).alias("bank_id"), call.alias("batch_id"), call.alias("at")
    )
    return entities.cooccurrence(rows).withColumnRenamed("last_cooccurred", "last_call")


@query(
    "cooccurrence_merge",
    f"""with ue as ({LINES_SQL})
select a.unit_id % 5 as bank_id, a.entity_id as entity_id_1, b.entity_id as entity_id_2, count(distinct a.unit_id // 25) as cooccurrence_count,
 max(a.unit_id // 25) as last_call
from ue a join ue b on a.unit_id = b.unit_id and a.entity_id < b.entity_id group by all""",
)
def _cooccurrence_merge(t: Tables):
    """Counts of the odd calls merged into the stored counts of the even ones."""
    call = F.floor(F.col("unit_id") / 25).cast("bigint")
    rows = _order_suppliers(t).select(
        "unit_id", "entity_id", (F.col("unit_id") % 5).alias("bank_id"), call.alias("batch_id"), call.alias("at")
    )
    tasks = entities.pair_tasks(rows)
    stored = entities.cooccurrence(rows.filter(call % 2 == 0), tasks)
    fresh = entities.cooccurrence(rows.filter(call % 2 == 1), tasks)
    return entities.merge_cooccurrence(stored, fresh, tasks).withColumnRenamed("last_cooccurred", "last_call")


@query(
    "cooccurrence_report",
    """select e1.canonical_name as name_1, e2.canonical_name as name_2, count(*) as shared_units,
 count(distinct left(u.text, 60)) as samples, min(left(u.text, 60)) as sample
from fx_unit_entities a join fx_unit_entities b on a.unit_id = b.unit_id and a.entity_id < b.entity_id
join fx_entities e1 on e1.entity_id = a.entity_id join fx_entities e2 on e2.entity_id = b.entity_id
join fx_units u on u.unit_id = a.unit_id group by all""",
    ("fx_unit_entities", "fx_entities", "fx_units"),
)
def _cooccurrence_report(t: Tables):
    return entities.cooccurrence_report(t.unit_entities, t.entities, t.units)


@query(
    "entity_graph",
    """select 'node' as kind, e.entity_id as a, cast(null as bigint) as b, count(x.unit_id) as weight
from fx_entities e left join fx_unit_entities x on x.entity_id = e.entity_id group by all
union all select 'edge', a.entity_id, b.entity_id, count(*) from fx_unit_entities a join fx_unit_entities b
 on a.unit_id = b.unit_id and a.entity_id < b.entity_id group by all""",
    ("fx_unit_entities", "fx_entities"),
)
def _entity_graph(t: Tables):
    nodes, edges = entities.entity_graph(t.entities, t.unit_entities)
    none = F.lit(None).cast("bigint")
    return nodes.select(
        F.lit("node").alias("kind"), F.col("entity_id").alias("a"), none.alias("b"), F.col("mentions").alias("weight")
    ).unionByName(
        edges.select(
            F.lit("edge").alias("kind"), F.col("entity_id_1").alias("a"), F.col("entity_id_2").alias("b"), "weight"
        )
    )


@query(
    "entity_obs_counts",
    """select x.entity_id, count(distinct x.unit_id) as obs_count from fx_unit_entities x join fx_units u on u.unit_id = x.unit_id
where u.fact_type = 'observation' group by 1 having count(distinct x.unit_id) >= 2""",
    ("fx_unit_entities", "fx_units"),
)
def _entity_obs_counts(t: Tables):
    observations = t.units.filter(F.col("fact_type") == "observation")
    return entities.entity_obs_counts(t.unit_entities, observations, 2)


@query(
    "entity_mentions",
    """select s.s_suppkey as entity_id, 1 + count(distinct l.l_orderkey) as mention_count,
 cast(greatest(epoch_us(timestamp '1996-01-01 00:00:00'), max(epoch_us(l.l_shipdate))) as bigint) as last_seen_us
from supplier s left join lineitem l on l.l_suppkey = s.s_suppkey group by 1""",
)
def _entity_mentions(t: Tables):
    stored = t.read("supplier").select(
        F.col("s_suppkey").alias("entity_id"),
        F.lit(1).cast("bigint").alias("mention_count"),
        F.lit("1996-01-01").cast("timestamp").alias("last_seen"),
    )
    matches = t.read("lineitem").select(
        F.col("l_suppkey").alias("entity_id"),
        F.col("l_orderkey").alias("batch_id"),
        F.col("l_shipdate").cast("timestamp").alias("at"),
    )
    after = entities.entity_mentions(stored, matches)
    return after.select("entity_id", "mention_count", F.unix_micros("last_seen").alias("last_seen_us"))


def _stored_cooccurrences(t: Tables):
    rows = t.unit_entities.join(t.units.select("unit_id", "bank_id", "batch_id", F.col("created_at").alias("at")), "unit_id")
    return entities.cooccurrence(rows)


@query(
    "cooc_names",
    """select distinct a.entity_id, lower(e.canonical_name) as company from fx_unit_entities a
join fx_unit_entities b on a.unit_id = b.unit_id and a.entity_id <> b.entity_id join fx_entities e on e.entity_id = b.entity_id""",
    ("fx_unit_entities", "fx_entities"),
)
def _cooc_names(t: Tables):
    return entities.cooc_names(_stored_cooccurrences(t), t.entities)


def _mentions(t: Tables):
    """Names as a call spells them: the supplier names of its units without two digits."""
    name = F.regexp_replace("canonical_name", "#00", " ")
    rows = t.unit_entities.join(t.entities, "entity_id").join(t.units.select("unit_id", "event_date"), "unit_id")
    return rows.select(F.col("unit_id").alias("call_id"), "bank_id", name.alias("name"), "event_date")


def _known_entities(t: Tables):
    return t.entities.withColumn("last_seen", as_of() - F.expr("interval 10 days"))


@query("entity_score")
def _entity_score(t: Tables):
    company = entities.cooc_names(_stored_cooccurrences(t), t.entities)
    return entities.entity_scores(_mentions(t), _known_entities(t), company).filter(
        F.col("score") >= entities.SCORE_THRESHOLD
    )


@query("resolve_entities")
def _resolve_entities(t: Tables):
    company = entities.cooc_names(_stored_cooccurrences(t), t.entities)
    return entities.resolve_entities(_mentions(t), _known_entities(t), company)


@query("name_ratio")
def _name_ratio(t: Tables):
    """Ratio of each part name to its brand and type, once per distinct pair."""
    pairs = t.read("part").select(F.lower("p_name").alias("a"), F.lower(F.concat_ws(" ", "p_brand", "p_type")).alias("b"))
    return pairs.distinct().withColumn("ratio", entities.name_ratio("a", "b"))
