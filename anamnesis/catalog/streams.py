"""Streaming queries, run to the end of the given tables, and the retain job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.catalog import REGISTRY, query
from anamnesis.catalog.fixtures import LINK_THRESHOLD, Tables, as_of
from anamnesis.catalog.memory import trim_sql
from anamnesis.functions import hooks
from anamnesis.operators import live
from anamnesis.operators.links import temporal_links
from anamnesis.operators.order import numbered, top
from anamnesis.plans import recall as recall_plan
from anamnesis.plans import retain as retain_plan
from anamnesis.plans.consolidation import consolidate_all
from anamnesis.session import scratch_path
from anamnesis.sources import tables
from anamnesis.streaming import live as streams
from anamnesis.streaming import timers
from anamnesis.streaming.fold import run_to_end


def _stream(t: Tables) -> DataFrame:
    schema = t.read("events").schema
    rows = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 8).parquet(t.sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    return run_to_end(stream, scratch_path(t.spark, name))


def _sql_of(name: str) -> str:
    return REGISTRY[name].sql


@query(
    "stream_comments_dedup",
    "select user_id as comment_id from events where user_id % 50 <> 0 group by 1 union all select null from events where user_id % 50 = 0",
)
def _stream_comments_dedup(t: Tables):
    ident = F.when(F.col("user_id") % 50 != 0, F.col("user_id"))
    comments = _stream(t).select(ident.alias("comment_id"), "ts")
    return _finish(t, streams.dedup_comments(comments, "60 days"), "dedup").select("comment_id")


@query("stream_continuity", _sql_of("continuity_state"))
def _stream_continuity(t: Tables):
    kind = F.col("event_type")
    comments = _stream(t).filter(~kind.isin("error", "signup")).select(
        (F.col("user_id") % 10).alias("channel_id"), live.tick_of(F.col("ts"), 600).alias("tick")
    )
    return _finish(t, streams.continuity(comments), "continuity")


@query(
    "stream_client_queue",
    """with ops as (select user_id as client_id, event_id as seq, epoch_us(ts) as us, case when event_type in ('view', 'purchase') then 'read' else 'post' end as op from events),
p as (select *, lag(us) over w as pus, lag(op) over w as pop from ops window w as (partition by client_id order by us, seq)),
runs as (select *, sum(case when pus is null or pop = 'read' or us - pus > 300000000 then 1 else 0 end) over (partition by client_id order by us, seq) as run from p)
select a.client_id, a.seq, b.seq as delivered_seq from runs a join runs b on b.client_id = a.client_id and b.run = a.run and b.op = 'read' where a.op = 'post'""",
)
def _stream_client_queue(t: Tables):
    op = F.when(F.col("event_type").isin("view", "purchase"), "read").otherwise("post")
    operations = _stream(t).select(F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), "ts", op.alias("op"))
    return _finish(t, streams.client_queue(operations), "queue")


@query("stream_presence")
def _stream_presence(t: Tables):
    detections = _stream(t).select(
        (F.col("user_id") % 10).alias("device_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("event_type").isin("click", "view", "purchase").alias("face_detected"),
    )
    return _finish(t, streams.presence(detections, 600, 1800, 3600), "presence")


@query(
    "stream_chunks",
    """, c as (select stream_id, seq, case when role = 'console' then 'code' else role end as role, type, text from fx_chunks where role <> 'user'),
p as (select *, lag(role) over w as prole, lag(type) over w as ptype from c window w as (partition by stream_id order by seq)),
r as (select *, sum(case when prole = role and coalesce(ptype, '') not in ('start', 'end') and coalesce(type, '') <> 'start' then 0 else 1 end)
 over (partition by stream_id order by seq) as run from p),
m as (select stream_id, run, min(seq) as seq, any_value(role) as role, string_agg(text, '' order by seq) filter (coalesce(type, '') <> 'start') as text,
 bool_or(coalesce(type, '') = 'end') as ended, count(*) filter (coalesce(type, '') <> 'start') as n from r group by 1, 2)
select stream_id, case when exists (select 1 from r where r.stream_id = m.stream_id and r.run = m.run and r.type = 'start')
 then (select min(r.seq) from r where r.stream_id = m.stream_id and r.run = m.run and coalesce(r.type, '') <> 'start') else seq end as seq, role, text
from m where n > 0 and (ended or run < (select max(run) from r x where x.stream_id = m.stream_id))""",
    ("fx_chunks",),
)
def _stream_chunks(t: Tables):
    kind = F.col("event_type")
    chunks = _stream(t).select(
        (F.col("user_id") % 10).alias("stream_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "purchase", "console").when(kind == "signup", "user").otherwise("assistant").alias("role"),
        F.when(kind == "error", "end").when((kind == "view") & (F.col("user_id") % 7 == 0), "start").alias("type"),
        F.concat(kind, F.lit(" ")).alias("text"),
    )
    return _finish(t, streams.assemble_chunks(chunks), "chunks")


# Timers run out up to the latest row of the stream, whoever's it is; a watermark counts whole milliseconds.
@query(
    "stream_idle_sleep",
    """with c as (select user_id % 10 as channel_id, epoch_us(ts) as us from events where event_type not in ('error', 'signup')),
clock as (select max(us) // 1000 * 1000 as now from c),
busy as (select channel_id, us // 600000000 as tick from c where us <= (select now from clock) group by all),
gaps as (select *, lead(tick) over (partition by channel_id order by tick) as following from busy),
told as (select channel_id, tick, n, following from gaps cross join (select unnest(range(7)) as n))
select channel_id, tick + n as tick, n as no_comment_count, case n when 0 then 'send_comment' when 6 then 'sleep' else 'process_messages' end as action, n = 6 as sleep_mode
from told where n = 0 or ((following is null or tick + n < following) and (tick + n + 1) * 600000000 <= (select now from clock))""",
)
def _stream_idle_sleep(t: Tables):
    comments = _stream(t).filter(~F.col("event_type").isin("error", "signup")).select((F.col("user_id") % 10).alias("channel_id"), "ts")
    return _finish(t, timers.idle_sleep(comments, 600, "0 seconds"), "idle-sleep")


@query(
    "stream_idle_clients",
    """with ops as (select user_id as client_id, event_id as seq, epoch_us(ts) as us, event_type in ('view', 'purchase') as reads from events),
p as (select *, lag(us) over w as pus, lag(reads) over w as preads from ops window w as (partition by client_id order by us, seq)),
runs as (select *, sum(case when pus is null or preads or us - pus > 300000000 then 1 else 0 end) over (partition by client_id order by us, seq) as run from p)
select client_id, count(*) as messages, max(us) + 300000000 as dropped_us from runs group by client_id, run
having not bool_or(reads) and max(us) + 300000001 <= (select max(us) // 1000 * 1000 from ops)""",
)
def _stream_idle_clients(t: Tables):
    op = F.when(F.col("event_type").isin("view", "purchase"), "read").otherwise("post")
    operations = _stream(t).select(F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), "ts", op.alias("op"))
    return _finish(t, timers.idle_clients(operations, "0 seconds"), "idle-clients")


@query("stream_departures")
def _stream_departures(t: Tables):
    face = F.col("event_type").isin("click", "view", "purchase").alias("face_detected")
    detections = _stream(t).select((F.col("user_id") % 10).alias("device_id"), "ts", F.col("event_id").alias("seq"), face)
    return _finish(t, timers.departures(detections, 600, 1800, 3600, "0 seconds"), "departures")


@query(
    "stream_utterances",
    f"""select * from ({_sql_of("silence_segments")}) where end_us + 1200000000 <= (select max(epoch_us(ts)) // 1000 * 1000 from events)""",
)
def _stream_utterances(t: Tables):
    speech = _stream(t).select((F.col("user_id") % 10).alias("device_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("text"))
    return _finish(t, timers.closed_utterances(speech, 1200, "0 seconds"), "utterances")


def _contents(t: Tables) -> DataFrame:
    """Every turn of a conversation is one retain call."""
    turns = t.read("conversations").select("conv_id", "turn", "role", "text")
    return numbered(turns, ["conv_id", "turn", "role", "text"], "call_id").select(
        "call_id",
        (F.col("conv_id") % 5).alias("bank_id"),
        "text",
        F.col("role").alias("context"),
    )


@query(
    "recall_response",
    f"""select s.query_id, cast(s.rn as integer) as rn, s.unit_id, u.fact_type, u.fact_kind, round(s.score, 4) as score,
 strftime(u.event_date, '%Y-%m-%dT%H:%M:%SZ') as event_date from ({trim_sql(8192, 100)}) s join fx_units u on u.unit_id = s.unit_id""",
    ("fx_scored", "fx_units"),
)
def _recall_response(t: Tables):
    found = recall_plan.recall(t.queries, t.units, t.links, as_of(), "high", seed_threshold=LINK_THRESHOLD)
    return recall_plan.response(found).drop("text", "context")


@query(
    "retain_links",
    """, fresh as (select * from fx_units where batch_id % 2 = 1), old as (select * from fx_units where batch_id % 2 = 0),
found as (select a.bank_id, a.unit_id as u, b.unit_id as o, row_number() over (partition by a.unit_id order by ab desc, b.unit_id desc) as rn, gap from (
 select a.*, b.unit_id as b_id, b.at as ab, abs(epoch_us(a.at) - epoch_us(b.at)) as gap from fx_timed a join fx_timed b on a.bank_id = b.bank_id
 and a.batch_id % 2 = 1 and b.batch_id % 2 = 0 and abs(epoch_us(a.at) - epoch_us(b.at)) <= 86400000000) a join fx_units b on b.unit_id = a.b_id),
own as (select a.bank_id, a.unit_id as u, b.unit_id as o, abs(epoch_us(a.at) - epoch_us(b.at)) as gap from fx_timed a join fx_timed b
 on a.bank_id = b.bank_id and a.batch_id = b.batch_id and a.unit_id <> b.unit_id and a.batch_id % 2 = 1 and abs(epoch_us(a.at) - epoch_us(b.at)) <= 86400000000)
select distinct bank_id, unnest([u, o]) as from_unit_id, unnest([o, u]) as to_unit_id, round(greatest(0.3, 1 - gap / 3600e6 / 24), 13) as weight
from (select bank_id, u, o, gap from found where rn <= 10 union all select * from own)""",
    ("fx_units", "fx_timed"),
)
def _retain_links(t: Tables):
    """Temporal links of the odd calls when the even ones are stored."""
    fresh, stored = (t.units.filter(F.col("batch_id") % 2 == odd) for odd in (1, 0))
    return temporal_links(fresh, stored).drop("link_type", "entity_id")


@query("consolidate_all")
def _consolidate_all(t: Tables):
    """All facts folded into observations, a thousand of a bank a round."""
    waiting = t.units.withColumns({"consolidated_at": F.lit(None).cast("timestamp"), "proof_count": F.lit(1).cast("bigint")})
    done = consolidate_all(waiting, t.obs_sources, as_of(), per_bank=1000)
    return done.units.groupBy("bank_id", "fact_type").agg(
        F.count("*").alias("units"), F.count("consolidated_at").alias("done"), F.sum("proof_count").alias("proofs")
    )


@query(
    "tables_load",
    "select l_orderkey as unit_id, l_suppkey as entity_id, count(*) as n from lineitem group by all",
)
def _tables_load(t: Tables):
    """A bridge table stored in two appends and read back with its schema."""
    path = scratch_path(t.spark, "tables")
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_suppkey").alias("entity_id"), "l_linenumber")
    for first in (True, False):
        part = rows.filter((F.col("l_linenumber") == 1) == F.lit(first))
        tables.store(part.drop("l_linenumber"), path, "unit_entities")
    return tables.load(t.spark, path, "unit_entities").groupBy("unit_id", "entity_id").agg(F.count("*").alias("n"))


@query(
    "recent_messages",
    "select conv_id, turn, rn from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn <= 3",
)
def _recent_messages(t: Tables):
    recent = top(t.messages, ["conv_id"], [F.desc("turn")], 3)
    return recent.select("conv_id", "turn", F.col("rn").cast("bigint").alias("rn"))


@query("retain")
def _retain(t: Tables):
    """What all retain calls add to the tables of each bank: units, entities, links of each kind, co-occurrences, mentions."""
    return retain_plan.added(retain_plan.retain(_contents(t), as_of()))


@query("embed_messages")
def _embed_messages(t: Tables):
    rows = hooks.with_embeddings(t.read("conversations").select("conv_id", "turn", "text"), "text")
    return rows.drop("text")
