"""Queries over vector, keyword and time-range search."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis.catalog import query
from anamnesis.catalog.fixtures import AS_OF, Tables, add_view, as_of, sim_sql
from anamnesis.catalog.functions import BEST_DATE_SQL, bigrams_sql
from anamnesis.operators import consolidate, search, temporal


def ranked_sql(queries: str, units: str, uid: str, threshold: float, k: int, where: str = "true", per: str = "") -> str:
    """SQL for the top k units of each query in its bank."""
    group = f", u.{per}" if per else ""
    return f"""select q.query_id, u.{uid} as {uid}{group}, {sim_sql("q.embedding", "u.embedding")} as similarity,
 row_number() over (partition by q.query_id{group} order by {sim_sql("q.embedding", "u.embedding")} desc, u.{uid}) as rn
from {queries} q join {units} u on u.bank_id = q.bank_id and ({where}) and {sim_sql("q.embedding", "u.embedding")} >= {threshold}
qualify rn <= {k}"""


@query(
    "semantic_search",
    f"select query_id, unit_id, fact_type, similarity from ({ranked_sql('fx_probes', 'fx_units', 'unit_id', 0.1, 34, per='fact_type')})",
    ("fx_units", "fx_probes"),
)
def _semantic_search(t: Tables):
    return search.semantic_search(t.probes, t.units)


FIRST_SOURCES_SQL = """(select obs_id, count(*) as n, min(source_id) as first_id from (
 select *, row_number() over (partition by obs_id order by source_id) as rn from fx_obs_sources) where rn <= 5 group by obs_id)"""


@query(
    "search_observations",
    f"""select r.query_id, r.unit_id, r.similarity, coalesce(s.n, 0) as n_sources, s.first_id, 'unknown' as freshness_status
from ({ranked_sql("fx_probes", "fx_units", "unit_id", 0.1, 20, "u.fact_type = 'observation' and (u.unit_id % 7 = 0 or u.tag = 'click' or u.unit_id % 2 = 0)")}) r
left join {FIRST_SOURCES_SQL} s on s.obs_id = r.unit_id""",
    ("fx_units", "fx_probes", "fx_obs_sources"),
)
def _search_observations(t: Tables):
    found = search.search_observations(t.probes, t.tagged_units, t.obs_sources, ["click", "lang_a"])
    return found.select(
        "query_id",
        "unit_id",
        "similarity",
        F.size("source_ids").cast("bigint").alias("n_sources"),
        F.get("source_ids", F.lit(0)).alias("first_id"),
        "freshness_status",
    )


@query(
    "search_facts",
    f"""select query_id, unit_id, similarity from ({ranked_sql("fx_probes", "fx_units", "unit_id", 0.1, 30,
    "u.fact_type <> 'observation' and u.unit_id % 7 <> 0 and u.unit_id % 2 = 0")})""",
    ("fx_units", "fx_probes"),
)
def _search_facts(t: Tables):
    return search.search_facts(t.probes, t.tagged_units, ["lang_a"], "all_strict").drop("rn")


@query(
    "search_models",
    f"""select r.query_id, r.model_id, r.similarity, coalesce(floor((epoch_us(timestamp '{AS_OF}') - epoch_us(m.last_refreshed_at)) / 86400e6) >= 7, true) as is_stale
from ({ranked_sql("fx_probes", "fx_models", "model_id", 0.1, 5, "u.source_query is null")}) r join fx_models m on m.model_id = r.model_id""",
    ("fx_units", "fx_probes", "fx_models"),
)
def _search_models(t: Tables):
    skip = t.models.filter(F.col("source_query").isNotNull()).select("model_id")
    return search.search_models(t.probes, t.models, as_of(), skip).drop("rn")


RELATED_SQL = ranked_sql("facts", "fx_units", "unit_id", 0.3, 10, "u.fact_type = 'observation'")


@query(
    "related_observations",
    f""", facts as (select unit_id as query_id, * from fx_units where fact_type <> 'observation'),
related as ({RELATED_SQL}),
shown as (select obs_id, source_id from (select *, row_number() over (partition by obs_id order by source_id) as rn from fx_obs_sources) where rn <= 5),
placed as (select s.obs_id, s.source_id, row_number() over (partition by s.obs_id order by u.created_at, s.source_id) as pos
 from shown s join fx_units u on u.unit_id = s.source_id)
select r.query_id, r.unit_id, r.similarity, p.source_id, p.pos from related r left join placed p on p.obs_id = r.unit_id""",
    ("fx_units", "fx_obs_sources"),
)
def _related_observations(t: Tables):
    facts = t.units.filter(F.col("fact_type") != "observation").withColumnRenamed("unit_id", "query_id")
    related = search.related_observations(facts, t.units, t.obs_sources).drop("rn")
    shown = search.source_memories(related, t.units, t.obs_sources)
    placed = shown.select(F.col("obs_id").alias("unit_id"), "source_id", F.col("pos").cast("bigint").alias("pos"))
    return related.join(placed, "unit_id", "left")


def _memory_sql(threshold: float) -> str:
    return f"""select query_id, record_id, similarity from (
 select a.vec_id as query_id, b.vec_id as record_id, {sim_sql("a.embedding", "b.embedding")} as similarity,
 row_number() over (partition by a.vec_id order by {sim_sql("a.embedding", "b.embedding")} desc, b.vec_id) as rn
 from embeddings a join embeddings b on {sim_sql("a.embedding", "b.embedding")} >= {threshold}) where rn <= 5"""


def _records(t: Tables):
    return t.read("embeddings").select(F.col("vec_id").alias("record_id"), "embedding")


@query("memory_search", _memory_sql(0.7))
def _memory_search(t: Tables):
    return search.memory_search(t.probes, _records(t)).drop("rn")


@query("memory_search_wide", _memory_sql(0.25))
def _memory_search_wide(t: Tables):
    return search.memory_search(t.probes, _records(t), threshold=0.25).drop("rn")


@query(
    "similarity_matrix",
    f"""select a.vec_id as query_id, b.vec_id as unit_id, {sim_sql("a.embedding", "b.embedding")} as similarity
from embeddings a join embeddings b on a.vec_id <> b.vec_id
qualify row_number() over (partition by a.vec_id order by {sim_sql("a.embedding", "b.embedding")} desc, b.vec_id) <= 30""",
)
def _similarity_matrix(t: Tables):
    rows = t.read("embeddings").select(F.col("vec_id").alias("unit_id"), "embedding")
    return search.similarity_matrix(rows).drop("rn")


@query("pca_2d")
def _pca_2d(t: Tables):
    return search.pca_2d(t.read("embeddings").select(F.col("vec_id").alias("unit_id"), "embedding"))


add_view(
    "fx_keywords",
    r"""select query_id, bank_id, unnest(case when len(kept) > 0 then kept when length(text) <= 20 then [text] else [] end) as keyword
from (select query_id, bank_id, text, list_distinct(list_filter(regexp_split_to_array(text, '[はがのをにでともやへか\s\p{Z}]+'),
 lambda k: length(k) >= 2)) as kept from fx_queries)""",
    "fx_queries",
)
add_view(
    "fx_keyword_hits",
    f"""
select query_id, unit_id, fact_type, score, row_number() over (partition by query_id, fact_type order by score desc, unit_id) as rn from (
 select k.query_id, u.unit_id, any_value(u.fact_type) as fact_type, round(max(g.score), 9) as score from fx_keywords k
 join (select w.bank_id, w.keyword, w.unit_id, max(w.shared / greatest(w.n_word, w.n_unit)) as score from (
   select kg.bank_id, kg.keyword, ug.unit_id, ug.field, count(*) as shared, any_value(kg.n) as n_word, any_value(ug.n) as n_unit from
    (select bank_id, keyword, len(grams) as n, unnest(grams) as gram from
      (select distinct bank_id, keyword, {bigrams_sql("keyword")} as grams from fx_keywords)) kg
    join (select bank_id, unit_id, field, len(grams) as n, unnest(grams) as gram from
      (select bank_id, unit_id, 't' as field, {bigrams_sql("text")} as grams from fx_units
       union all select bank_id, unit_id, 'c', {bigrams_sql("coalesce(context, '')")} from fx_units)) ug
    on ug.bank_id = kg.bank_id and ug.gram = kg.gram group by all) w group by all) g on g.bank_id = k.bank_id and g.keyword = k.keyword
 join fx_units u on u.unit_id = g.unit_id
 group by k.query_id, u.unit_id
 having bool_or(contains(u.text, k.keyword) or coalesce(contains(u.context, k.keyword), false)))
qualify rn <= 34""",
    "fx_keywords",
    "fx_units",
)


@query("keyword_search", "select query_id, unit_id, fact_type, score from fx_keyword_hits", ("fx_keyword_hits",))
def _keyword_search(t: Tables):
    return search.keyword_search(t.queries, t.units)


def proximity_sql(best: str, start: str, end: str) -> str:
    mid = f"(epoch_us({start}) + epoch_us({end})) // 2"
    total = f"greatest((epoch_us({end}) - epoch_us({start})) / 86400e6, 0.01)"
    return f"greatest(0, 1 - abs(epoch_us({best}) - {mid}) / 86400e6 / ({total} / 2))"


def entries_sql(queries: str) -> str:
    proximity = proximity_sql(BEST_DATE_SQL.format("u."), "q.range_start", "q.range_end")
    return f"""select q.query_id, u.unit_id, round(coalesce({proximity}, 0.5), 9) as score
from {queries} q join fx_units u on u.bank_id = q.bank_id and (
 (u.occurred_start <= q.range_end and u.occurred_end >= q.range_start) or u.mentioned_at between q.range_start and q.range_end
 or u.occurred_start between q.range_start and q.range_end or u.occurred_end between q.range_start and q.range_end
 or u.event_date between q.range_start and q.range_end)
 and {sim_sql("q.embedding", "u.embedding")} >= 0.1
qualify row_number() over (partition by q.query_id
 order by coalesce(u.occurred_start, u.occurred_end, u.mentioned_at, u.event_date) desc, u.unit_id) <= 20"""


def spread_sql(queries: str, entries: str) -> str:
    proximity = proximity_sql(BEST_DATE_SQL.format("u."), "q.range_start", "q.range_end")
    return f"""select query_id, unit_id, max(score) as score from (
 select *, min(case when place >= free then first_rn end) over (partition by query_id) as stop from (
  select f.*, dense_rank() over (partition by f.query_id order by f.first_rn) as place, n.free from (
   select *, min(rn) over (partition by query_id, unit_id) as first_rn from (
    select q.query_id, u.unit_id, round(greatest(coalesce({proximity}, 0), e.score * l.weight
      * case when l.link_type = 'temporal' then 1.0 else 2.0 end * 0.7), 9) as score,
     row_number() over (partition by q.query_id order by l.weight desc, u.unit_id, e.unit_id, l.link_type) as rn
    from {entries} e join {queries} q on q.query_id = e.query_id
    join fx_links l on l.from_unit_id = e.unit_id and l.bank_id = q.bank_id
     and l.link_type in ('temporal', 'causes', 'caused_by') and l.weight >= 0.1
    join fx_units u on u.unit_id = l.to_unit_id and u.bank_id = q.bank_id
    where {sim_sql("q.embedding", "u.embedding")} >= 0.1
    qualify rn <= 50) r
   where score >= 0.05 and not exists (select 1 from {entries} x where x.query_id = r.query_id and x.unit_id = r.unit_id)) f
  join (select query_id, 50 - count(*) as free from {entries} group by query_id) n on n.query_id = f.query_id))
where stop is null or rn <= stop group by query_id, unit_id"""


add_view("fx_entries", entries_sql("fx_probes"), "fx_probes", "fx_units")
add_view("fx_spread", spread_sql("fx_probes", "fx_entries"), "fx_entries", "fx_links")


@query("temporal_entry", "select * from fx_entries", ("fx_entries",))
def _temporal_entry(t: Tables):
    return temporal.entry_points(t.probes, t.units)


@query("temporal_spread", "select * from fx_spread", ("fx_spread",))
def _temporal_spread(t: Tables):
    return temporal.spread(t.probes, t.units, t.links, temporal.entry_points(t.probes, t.units))


@query(
    "temporal_search",
    """select query_id, unit_id, score, rn from (
 select *, row_number() over (partition by query_id order by score desc, unit_id) as rn
 from (select * from fx_entries union all select * from fx_spread)) where rn <= 50""",
    ("fx_entries", "fx_spread"),
)
def _temporal_search(t: Tables):
    return temporal.temporal_search(t.probes, t.units, t.links).withColumn("rn", F.col("rn").cast("bigint"))


@query(
    "units_in_range",
    """select r.o_orderkey as query_id, l.l_orderkey as unit_id, l.l_linenumber as line from orders r
join lineitem l on l.l_orderkey % 5 = r.o_orderkey % 5 and l.l_suppkey = r.o_custkey
 and l.l_shipdate between r.o_orderdate and r.o_orderdate + interval '3' day""",
)
def _units_in_range(t: Tables):
    """Shipments within three days of an order, for customer and supplier numbers that agree."""
    none = F.lit(None).cast("timestamp")
    orders = t.read("orders").select(
        F.col("o_orderkey").alias("query_id"),
        F.concat_ws("/", F.col("o_orderkey") % 5, F.col("o_custkey")).alias("bank_id"),
        F.col("o_orderdate").cast("timestamp").alias("range_start"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("interval 3 days")).alias("range_end"),
    )
    lines = t.read("lineitem").select(
        F.col("l_orderkey").alias("unit_id"),
        F.col("l_linenumber").alias("line"),
        F.concat_ws("/", F.col("l_orderkey") % 5, F.col("l_suppkey")).alias("bank_id"),
        none.alias("occurred_start"),
        none.alias("occurred_end"),
        F.col("l_shipdate").cast("timestamp").alias("mentioned_at"),
        none.alias("event_date"),
    )
    return temporal.units_in_range(orders, lines).select("query_id", "unit_id", "line")


@query(
    "fetch_details",
    """select p.p_partkey, l.l_orderkey, l.l_linenumber from part p join lineitem l on l.l_partkey = p.p_partkey and l.l_orderkey % 5 = p.p_partkey % 5""",
)
def _fetch_details(t: Tables):
    """Rows looked up by id inside their own bank; ids of other banks drop out."""
    wanted = t.read("part").select("p_partkey", (F.col("p_partkey") % 5).alias("bank_id"))
    lines = t.read("lineitem").select(
        F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") % 5).alias("bank_id"), "l_orderkey", "l_linenumber"
    )
    return wanted.join(lines, ["bank_id", "p_partkey"]).drop("bank_id")


@query(
    "unconsolidated",
    """select bank_id, unit_id, rn from (select bank_id, unit_id, row_number() over (partition by bank_id order by created_at, unit_id) as rn
from fx_units where fact_type <> 'observation') where rn <= 10""",
    ("fx_units",),
)
def _unconsolidated(t: Tables):
    waiting = t.units.withColumn("consolidated_at", F.lit(None).cast("timestamp"))
    return consolidate.unconsolidated(waiting).select("bank_id", "unit_id", F.col("rn").cast("bigint").alias("rn"))
