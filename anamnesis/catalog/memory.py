"""Queries over fusion, recall, retain, consolidation, summaries and reflection."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis.catalog import query
from anamnesis.catalog.fixtures import AS_OF, LINK_THRESHOLD, Tables, add_view, as_of, sim_sql
from anamnesis.catalog.functions import trigrams_sql
from anamnesis.catalog.graph import FUSE_SQL, SEEDS_SQL, start_sql, walk_sql
from anamnesis.catalog.search import FIRST_SOURCES_SQL, entries_sql, proximity_sql, ranked_sql, spread_sql
from anamnesis.operators import consolidate, dedup, freshness, fuse, reflect, search, summaries, walk
from anamnesis.plans import recall as recall_plan

add_view("fx_q_semantic", ranked_sql("fx_queries", "fx_units", "unit_id", 0.1, 34, per="fact_type"), "fx_queries", "fx_units")
add_view("fx_q_seeds", SEEDS_SQL.format("fx_q_semantic", LINK_THRESHOLD), "fx_q_semantic")
add_view("fx_q_walk", walk_sql(start_sql("fx_q_seeds", walk.SEMANTIC_PATTERNS, 0)), "fx_q_seeds", "fx_edges")
add_view("fx_q_graph", FUSE_SQL.format("fx_q_walk"), "fx_q_walk")
add_view("fx_q_entries", entries_sql("fx_queries"), "fx_queries", "fx_units")
add_view("fx_q_spread", spread_sql("fx_queries", "fx_q_entries"), "fx_q_entries", "fx_links")
add_view(
    "fx_fused",
    """select l.query_id, u.unit_id, round(sum(1.0 / (60 + l.rank)), 9) as rrf from (
 select query_id, unit_id, row_number() over (partition by query_id, list order by score desc, unit_id) - 1 as rank from (
  select query_id, unit_id, similarity as score, 'semantic' as list from fx_q_semantic
  union all select query_id, unit_id, score, 'keyword' from fx_keyword_hits
  union all select query_id, node, score, 'graph' from fx_q_graph
  union all select query_id, unit_id, score, 'temporal' from (select * from (select * from fx_q_entries union all select * from fx_q_spread)
   qualify row_number() over (partition by query_id order by score desc, unit_id) <= 50))) l
join fx_queries q on q.query_id = l.query_id join fx_units u on u.unit_id = l.unit_id and u.bank_id = q.bank_id group by all""",
    "fx_q_semantic",
    "fx_keyword_hits",
    "fx_q_graph",
    "fx_q_entries",
    "fx_q_spread",
)
RECENCY_SQL = f"greatest(0, 1 - greatest(0, (epoch_us(timestamp '{AS_OF}') - epoch_us(u.created_at)) / 86400e6) / 365)"
NEAR_SQL = proximity_sql("coalesce(u.occurred_start, u.mentioned_at)", "q.range_start", "q.range_end")
add_view(
    "fx_scored",
    f"""select f.query_id, f.unit_id, f.rrf, round(0.5 * 0.0 + 0.3 * f.rrf / max(f.rrf) over (partition by f.query_id)
 + 0.1 * {RECENCY_SQL} + 0.1 * coalesce({NEAR_SQL}, 0), 9) as score, length(u.text) + coalesce(length(u.context), 0) as n
from (select * from fx_fused qualify row_number() over (partition by query_id order by rrf desc, unit_id) <= 300) f
join fx_queries q on q.query_id = f.query_id join fx_units u on u.unit_id = f.unit_id""",
    "fx_fused",
)


def trim_sql(tokens: int, results: int) -> str:
    return f"""select query_id, unit_id, score, rn, cast(chars as bigint) as chars from (
 select *, sum(n) over (partition by query_id order by rn) as chars from (
  select *, row_number() over (partition by query_id order by score desc, unit_id) as rn from fx_scored) where rn <= {results})
where rn = 1 or chars <= {tokens * 3}"""


def _lists(t: Tables):
    return recall_plan.candidates(t.queries, t.units, t.links, LINK_THRESHOLD)


@query("rrf_fuse", "select * from fx_fused", ("fx_fused",))
def _rrf_fuse(t: Tables):
    return fuse.fuse(_lists(t), t.units, t.queries).select("query_id", "unit_id", "rrf")


@query("final_score", "select query_id, unit_id, rrf, score from fx_scored", ("fx_scored",))
def _final_score(t: Tables):
    fused = fuse.fuse(_lists(t), t.units, t.queries)
    scored = fuse.final_score(fuse.rerank(fused, t.queries), t.queries, as_of())
    return scored.select("query_id", "unit_id", "rrf", "score")


def _recalled(t: Tables, budget: str):
    found = recall_plan.recall(t.queries, t.units, t.links, as_of(), budget, seed_threshold=LINK_THRESHOLD)
    return found.select("query_id", "unit_id", "score", F.col("rn").cast("bigint").alias("rn"), "chars")


@query("recall", trim_sql(4096, 50), ("fx_scored",))
def _recall(t: Tables):
    return _recalled(t, "mid")


@query("trim_budget", trim_sql(2048, 20), ("fx_scored",))
def _trim_budget(t: Tables):
    return _recalled(t, "low")


@query("rerank_results")
def _rerank_results(t: Tables):
    """Candidates of the semantic list rescored by a word-overlap scorer."""

    def overlap(asked, documents):
        import pandas as pd

        words = [set(q.lower().split()) for q in asked]
        return pd.Series([len(w & set(d.lower().split())) / max(len(w), 1) for w, d in zip(words, documents, strict=True)])

    semantic = search.semantic_search(t.queries, t.units).select("query_id", "unit_id", F.col("similarity").alias("score"))
    fused = fuse.fuse({"semantic": semantic}, t.units, t.queries)
    return fuse.rerank(fused, t.queries, overlap).select("query_id", "unit_id", "rrf", "ce_score")


BUCKET_SQL = "epoch_us({}) // 43200000000"
add_view(
    "fx_covering",
    f"""select a.unit_id as earlier, b.unit_id as unit_id, b.event_date is not null as dated from fx_units a join fx_units b
on a.bank_id = b.bank_id and a.unit_id < b.unit_id and {sim_sql("a.embedding", "b.embedding")} >= {LINK_THRESHOLD}
 and case when b.event_date is not null then {BUCKET_SQL.format("a.event_date")} = {BUCKET_SQL.format("b.event_date")}
  else a.fact_kind = 'conversation' end""",
    "fx_units",
)


@query("dedup_event", "select earlier, unit_id from fx_covering where dated", ("fx_covering",))
def _dedup_event(t: Tables):
    events = t.units.filter(F.col("event_date").isNotNull())
    return dedup.covering_pairs(events, events.limit(0), LINK_THRESHOLD)


@query("dedup_conversation", "select earlier, unit_id from fx_covering where not dated", ("fx_covering",))
def _dedup_conversation(t: Tables):
    talk = t.units.filter(F.col("event_date").isNull())
    return dedup.covering_pairs(talk, talk.limit(0), LINK_THRESHOLD)


@query(
    "retain_keep",
    """, nb as (select u.bank_id, u.unit_id, row_number() over (partition by u.bank_id order by u.unit_id) as i,
 coalesce((select list(p.earlier) from fx_covering p where p.unit_id = u.unit_id), []) as prev from fx_units u),
walk as (select distinct bank_id, cast(0 as bigint) as i, cast([] as bigint[]) as kept from nb
 union all select w.bank_id, n.i, case when list_has_any(n.prev, w.kept) then w.kept else list_append(w.kept, n.unit_id) end
 from walk w join nb n on n.bank_id = w.bank_id and n.i = w.i + 1)
select unnest(kept) as unit_id from walk qualify i = max(i) over (partition by bank_id)""",
    ("fx_covering",),
)
def _retain_keep(t: Tables):
    return dedup.keep_new(t.units, threshold=LINK_THRESHOLD).select("unit_id")


FRESH_AS_OF = "2024-02-20 00:00:00"
add_view(
    "fx_freshness",
    f"""select bank_id, obs_id, case when coalesce(recent, 0) = 0 then 'stale' when older = 0 then 'new'
 when ratio > 1.5 then 'strengthening' when ratio < 0.5 then 'weakening' else 'stable' end as freshness_status from (
 select u.bank_id, u.unit_id as obs_id, e.recent, e.older, (e.recent / 30) / (e.older / greatest(greatest(
  (epoch_us(timestamp '{FRESH_AS_OF}') - epoch_us(e.earliest)) / 86400e6, 1) - 30, 1)) as ratio
 from fx_units u left join (
  select s.obs_id, count(*) filter (v.created_at > timestamp '{FRESH_AS_OF}' - interval '30' day) as recent,
   count(*) filter (v.created_at <= timestamp '{FRESH_AS_OF}' - interval '30' day) as older, min(v.created_at) as earliest
  from fx_obs_sources s join fx_units v on v.unit_id = s.source_id group by 1) e on e.obs_id = u.unit_id
 where u.fact_type = 'observation')""",
    "fx_units",
    "fx_obs_sources",
)


def _freshness(t: Tables):
    observations = t.units.filter(F.col("fact_type") == "observation")
    return freshness.freshness(observations, t.obs_sources, t.units, F.lit(FRESH_AS_OF).cast("timestamp"))


@query("freshness", "select * from fx_freshness", ("fx_freshness",))
def _freshness_query(t: Tables):
    return _freshness(t)


@query(
    "freshness_counts",
    "select bank_id, freshness_status, count(*) as observations from fx_freshness group by all",
    ("fx_freshness",),
)
def _freshness_counts(t: Tables):
    return freshness.freshness_counts(_freshness(t))


add_view("fx_facts", "select unit_id as query_id, * from fx_units where fact_type <> 'observation'", "fx_units")
add_view(
    "fx_decided",
    f"""select f.unit_id as fact_id, case when r.unit_id is null then 'create' else 'update' end as action, r.unit_id as learning_id
from fx_facts f left join ({ranked_sql("fx_facts", "fx_units", "unit_id", 0.3, 1, "u.fact_type = 'observation'")}) r on r.query_id = f.unit_id""",
    "fx_facts",
)


def _decided(t: Tables):
    """All facts, and the action decided for each."""
    facts = t.units.filter(F.col("fact_type") != "observation")
    related = search.related_observations(facts.withColumnRenamed("unit_id", "query_id"), t.units, t.obs_sources)
    return facts, consolidate.nearest_decides(facts, related)


@query(
    "obs_create",
    f"""select d.fact_id, f.bank_id, md5(f.text) as text_md5, cast(epoch_us(coalesce(f.occurred_start, timestamp '{AS_OF}')) as bigint) as start_us,
 cast(epoch_us(coalesce(f.occurred_end, timestamp '{AS_OF}')) as bigint) as end_us, cast(epoch_us(f.mentioned_at) as bigint) as mentioned_us,
 cast(epoch_us(f.event_date) as bigint) as event_us, cast(1 as bigint) as proof_count
from fx_decided d join fx_units f on f.unit_id = d.fact_id where d.action = 'create'""",
    ("fx_decided",),
)
def _obs_create(t: Tables):
    facts, actions = _decided(t)
    made = consolidate.created_observations(actions, facts, as_of())
    return made.select("fact_id", "bank_id", F.md5("text").alias("text_md5"), *_dates_us(), "proof_count")


def _dates_us():
    names = {"occurred_start": "start_us", "occurred_end": "end_us", "mentioned_at": "mentioned_us", "event_date": "event_us"}
    return [F.unix_micros(c).alias(n) for c, n in names.items()]


@query(
    "obs_update",
    """select o.unit_id, md5(max_by(f.text, (f.created_at, f.unit_id))) as text_md5,
 cast(epoch_us(least(o.occurred_start, min(f.occurred_start))) as bigint) as start_us,
 cast(epoch_us(greatest(o.occurred_end, max(f.occurred_end))) as bigint) as end_us,
 cast(epoch_us(greatest(o.mentioned_at, max(f.mentioned_at))) as bigint) as mentioned_us, count(*) as changes,
 (select count(*) from (select s.source_id from fx_obs_sources s where s.obs_id = o.unit_id
  union select x.fact_id from fx_decided x where x.learning_id = o.unit_id)) as proof_count
from fx_decided d join fx_units o on o.unit_id = d.learning_id join fx_units f on f.unit_id = d.fact_id
group by o.unit_id, o.occurred_start, o.occurred_end, o.mentioned_at""",
    ("fx_decided", "fx_obs_sources"),
)
def _obs_update(t: Tables):
    facts, actions = _decided(t)
    observations = t.units.filter(F.col("fact_type") == "observation")
    changed = consolidate.updated_observations(observations, t.obs_sources, actions, facts)
    return changed.select("unit_id", F.md5("text").alias("text_md5"), *_dates_us()[:3], "changes", "proof_count")


@query(
    "obs_history",
    """select d.learning_id as obs_id, d.fact_id as source_id,
 md5(coalesce(lag(f.text) over (partition by d.learning_id order by f.created_at, d.fact_id), o.text)) as previous_md5
from fx_decided d join fx_units o on o.unit_id = d.learning_id join fx_units f on f.unit_id = d.fact_id""",
    ("fx_decided",),
)
def _obs_history(t: Tables):
    facts, actions = _decided(t)
    return consolidate.history(t.units, actions, facts, as_of()).select(
        "obs_id", "source_id", F.md5("previous_text").alias("previous_md5")
    )


@query(
    "obs_entities",
    """select distinct d.learning_id as unit_id, x.entity_id from fx_decided d join fx_unit_entities x on x.unit_id = d.fact_id
where not exists (select 1 from fx_unit_entities k where k.unit_id = d.learning_id and k.entity_id = x.entity_id) and d.learning_id is not null""",
    ("fx_decided", "fx_unit_entities"),
)
def _obs_entities(t: Tables):
    _, actions = _decided(t)
    return consolidate.inherited_entities(actions, t.unit_entities, t.unit_entities)


@query(
    "consolidate",
    """select f.bank_id, d.fact_id, d.action, d.learning_id from (select bank_id, unit_id from fx_facts
 qualify row_number() over (partition by bank_id order by created_at, unit_id) <= 10) f join fx_decided d on d.fact_id = f.unit_id""",
    ("fx_decided",),
)
def _consolidate(t: Tables):
    waiting = t.units.withColumn("consolidated_at", F.lit(None).cast("timestamp"))
    facts, actions = consolidate.decide_round(waiting, t.obs_sources)
    banks = facts.select(F.col("unit_id").alias("fact_id"), "bank_id")
    return actions.join(banks, "fact_id").select("bank_id", "fact_id", "action", "learning_id")


@query(
    "consolidation_stats",
    """select f.bank_id, count(*) as processed, count(*) filter (d.action = 'create') as created,
 count(*) filter (d.action = 'update') as updated, cast(0 as bigint) as skipped from fx_facts f join fx_decided d on d.fact_id = f.unit_id group by 1""",
    ("fx_decided",),
)
def _consolidation_stats(t: Tables):
    facts, actions = _decided(t)
    return consolidate.consolidation_stats(facts, actions)


@query(
    "models_refreshable",
    """select bank_id, model_id, 'any' as tags_match from fx_models where refresh_after_consolidation and source_query is not null
qualify row_number() over (partition by bank_id order by created_at, model_id) <= 3""",
    ("fx_models",),
)
def _models_refreshable(t: Tables):
    untagged = t.models.withColumn("tags", F.lit(None).cast("array<string>"))
    return summaries.refreshable(untagged).select("bank_id", "model_id", "tags_match")


@query(
    "generation_candidates",
    """select * from (select e.bank_id, x.entity_id, e.canonical_name, count(distinct x.unit_id) as obs_count from fx_unit_entities x
join fx_units u on u.unit_id = x.unit_id and u.fact_type = 'observation' join fx_entities e on e.entity_id = x.entity_id
where not exists (select 1 from fx_models m where m.entity_id = x.entity_id) group by all having count(distinct x.unit_id) >= 2)
qualify row_number() over (partition by bank_id order by obs_count desc, entity_id) <= 2""",
    ("fx_unit_entities", "fx_entities", "fx_models"),
)
def _generation_candidates(t: Tables):
    affected = t.units.filter(F.col("fact_type") == "observation").select("unit_id")
    found = summaries.generation_candidates(affected, t.units, t.unit_entities, t.entities, t.models, at_least=2)
    return found.select("bank_id", "entity_id", "canonical_name", "obs_count")


@query(
    "model_exists",
    f""", e as (select *, {trigrams_sql("canonical_name")} as g from fx_entities), m as (select *, {trigrams_sql("name")} as g from fx_models)
select distinct e.bank_id, e.entity_id from e join m on m.bank_id = e.bank_id and (m.entity_id = e.entity_id
 or len(list_intersect(e.g, m.g)) / len(list_distinct(list_concat(e.g, m.g))) >= 0.8)""",
    ("fx_entities", "fx_models"),
)
def _model_exists(t: Tables):
    return summaries.has_model(t.entities, t.models)


@query(
    "models_page",
    """select bank_id, model_id, rn from (select *, row_number() over (partition by bank_id order by created_at desc, model_id) as rn
 from fx_models) where rn between 11 and 30""",
    ("fx_models",),
)
def _models_page(t: Tables):
    return summaries.page(t.models, 20, 10).select("bank_id", "model_id", F.col("rn").cast("bigint").alias("rn"))


@query(
    "models_patch",
    f"""select m.model_id, case when m.model_id % 2 = 0 then 'renamed' else m.name end as name, case when m.model_id % 3 = 0 then 'new text' else 'old text' end as content,
 cast(epoch_us(case when m.model_id % 3 = 0 then timestamp '{AS_OF}' else m.last_refreshed_at end) as bigint) as refreshed_us from fx_models m""",
    ("fx_models",),
)
def _models_patch(t: Tables):
    m = F.col("model_id")
    stored = t.models.withColumn("content", F.lit("old text"))
    changes = stored.filter((m % 2 == 0) | (m % 3 == 0)).select(
        "bank_id",
        "model_id",
        F.when(m % 2 == 0, "renamed").alias("name"),
        F.when(m % 3 == 0, "new text").alias("content"),
        "embedding",
    )
    after = summaries.patch(stored, changes, as_of())
    return after.select("model_id", "name", "content", F.unix_micros("last_refreshed_at").alias("refreshed_us"))


EXPAND_SQL = """, asked as (select l_orderkey as query_id, l_orderkey % 5 as bank_id, l_partkey % nv.n as unit_id, l_linenumber - 1 as pos
 from lineitem cross join (select count(*) n from embeddings) nv),
pieces as (select bank_id, unit_id, unnest(range(0, (length(text) + 499) // 500)) as chunk_index, text from fx_units),
found as (select distinct a.query_id, u.unit_id, u.fact_type from asked a join fx_units u on u.bank_id = a.bank_id and u.unit_id = a.unit_id where a.pos < 10),
shown as (select f.query_id, f.unit_id, p.chunk_index, substr(p.text, p.chunk_index * 500 + 1, 500) as chunk from found f join pieces p on p.unit_id = f.unit_id
 qualify row_number() over (partition by f.query_id order by f.unit_id, p.chunk_index) <= 100)
select f.query_id, f.unit_id, f.fact_type, cast(s.chunk_index as integer) as chunk_index, md5(s.chunk) as chunk_md5
from found f left join shown s on s.query_id = f.query_id and s.unit_id = f.unit_id"""


@query("expand_units", EXPAND_SQL, ("fx_units",))
def _expand_units(t: Tables):
    n = t.read("embeddings").agg(F.count("*")).scalar()
    asked = t.read("lineitem").select(
        F.col("l_orderkey").alias("query_id"),
        (F.col("l_orderkey") % 5).alias("bank_id"),
        F.col("l_partkey").alias("part"),
        (F.col("l_linenumber") - 1).alias("pos"),
    ).withColumn("unit_id", F.col("part") % n)
    first = asked.groupBy("query_id", "bank_id", "unit_id").agg(F.min("pos").alias("pos"))
    rows = reflect.expand_units(first, t.units, reflect.chunks(t.units))
    return rows.select("query_id", "unit_id", "fact_type", "chunk_index", F.md5("text").alias("chunk_md5"))


@query(
    "evidence_validate",
    """select o.o_orderkey as query_id, count(*) filter (l.l_linenumber % 2 = 1) as kept, count(*) filter (l.l_linenumber % 2 = 0) as removed,
 count(l.l_orderkey) = 0 and o.o_orderkey % 10 < 9 as rejected
from orders o left join lineitem l on l.l_orderkey = o.o_orderkey group by o.o_orderkey""",
)
def _evidence_validate(t: Tables):
    """Lines cite themselves; only the odd ones were really found."""
    lines = t.read("lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.lit("fact").alias("tier"), F.col("l_linenumber").alias("id")
    )
    answers = t.read("orders").select(
        F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 10).alias("iteration")
    )
    valid, verdict = reflect.validate_evidence(lines, lines.filter(F.col("id") % 2 == 1), answers)
    kept = valid.groupBy("query_id").agg(F.count("*").alias("kept"))
    return verdict.join(kept, "query_id", "left").na.fill(0, ["kept"])


@query(
    "reflect_lookup",
    f""", facts as ({ranked_sql("fx_probes", "fx_units", "unit_id", 0.1, 30,
    "u.fact_type <> 'observation' and u.unit_id % 7 <> 0 and u.unit_id % 2 = 0")}),
pieces as (select unit_id, unnest(range(0, (length(text) + 499) // 500)) as chunk_index, text from fx_units),
found as (select query_id, unit_id from facts where rn <= 10),
shown as (select f.query_id, f.unit_id, p.chunk_index, md5(substr(p.text, p.chunk_index * 500 + 1, 500)) as chunk_md5
 from found f join pieces p on p.unit_id = f.unit_id
 qualify row_number() over (partition by f.query_id order by f.unit_id, p.chunk_index) <= 100)
select r.query_id, 'model' as tier, r.model_id as id, r.similarity,
 coalesce(floor((epoch_us(timestamp '{AS_OF}') - epoch_us(m.last_refreshed_at)) / 86400e6) >= 7, true) as is_stale,
 cast(null as varchar) as freshness_status, cast(null as bigint) as n_sources, cast(null as integer) as chunk_index, cast(null as varchar) as chunk_md5
from ({ranked_sql("fx_probes", "fx_models", "model_id", 0.1, 5,
    "u.model_id % 7 <> 0 and u.model_id % 2 = 0 and not u.refresh_after_consolidation")}) r join fx_models m on m.model_id = r.model_id
union all select r.query_id, 'observation', r.unit_id, r.similarity, null, 'unknown', coalesce(s.n, 0), null, null from ({ranked_sql("fx_probes", "fx_units", "unit_id", 0.1, 20,
    "u.fact_type = 'observation' and u.unit_id % 7 <> 0 and u.unit_id % 2 = 0")}) r left join {FIRST_SOURCES_SQL} s on s.obs_id = r.unit_id
union all select query_id, 'fact', unit_id, similarity, null, null, null, null, null from facts
union all select f.query_id, 'expanded', f.unit_id, null, null, null, null, cast(s.chunk_index as integer), s.chunk_md5
from found f left join shown s on s.query_id = f.query_id and s.unit_id = f.unit_id""",
    ("fx_probes", "fx_units", "fx_models", "fx_obs_sources"),
)
def _reflect_lookup(t: Tables):
    m = F.col("model_id")
    tagged = t.models.withColumn("tags", F.when(m % 7 != 0, F.array(F.when(m % 2 == 0, "lang_a").otherwise("lang_b"))))
    excluded = t.models.filter("refresh_after_consolidation").select("model_id")
    # a chunk is shown by its digest, which is all that meets the queries
    pieces = reflect.chunks(t.units).withColumn("text", F.md5("text"))
    found = reflect.reflect_lookup(
        t.probes, t.tagged_units, t.obs_sources, tagged, as_of(), ["lang_a"], "any_strict", excluded, pieces
    )
    shown = ["query_id", "tier", "id", "similarity", "is_stale", "freshness_status"]
    return found.select(*shown, F.size("source_ids").cast("bigint").alias("n_sources"), "chunk_index", F.col("text").alias("chunk_md5"))
