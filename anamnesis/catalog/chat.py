"""Queries over log files, stored tables, messages and live streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from anamnesis.catalog import query
from anamnesis.catalog.fixtures import AS_OF, Tables, add_view, as_of
from anamnesis.catalog.functions import US
from anamnesis.functions import chat
from anamnesis.functions.dates import format_ts
from anamnesis.operators import chatlog, live, search
from anamnesis.session import scratch_path
from anamnesis.sources import chatlog as logs
from anamnesis.sources import comments as payloads
from anamnesis.sources import tables

FILE_SQL = "'log_' || strftime(timestamp '2024-01-01 00:00:00' + conv_id * interval '1' minute, '%Y-%m-%dT%H-%M-%S') || '.json'"
add_view(
    "fx_log",
    f"""select {FILE_SQL} as file_name, turn, role, case when turn % 3 = 2 then null else text end as content,
 case when turn % 2 = 0 then strftime(timestamp '2024-01-01 00:00:00' + conv_id * interval '1' minute, '%Y-%m-%dT%H:%M:%SZ') end as ts, turn % 4 = 0 as embedded
from conversations""",
)


def _log(t: Tables):
    """Every conversation as a log file; some messages lack text, time or embedding."""
    turn = F.col("turn")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60)
    return t.read("conversations").select(
        F.concat(F.lit("log_"), F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss"), F.lit(".json")).alias("file_name"),
        turn.alias("turn"),
        "role",
        F.when(turn % 3 != 2, F.col("text")).alias("content"),
        F.when(turn % 2 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.when(turn % 4 == 0, F.array(F.lit(0.5))).alias("embedding"),
    )


@query(
    "chatlog_read",
    "select file_name, turn, role, md5(content) as content_md5, ts, embedded from fx_log union all select file_name, turn, role, md5(content), ts, embedded from fx_log where turn = 0",
    ("fx_log",),
)
def _chatlog_read(t: Tables):
    """Logs written, appended to and read back."""
    path = scratch_path(t.spark, "chatlog")
    logs.write_lines(_log(t), path)
    logs.write_lines(_log(t).filter(F.col("turn") == 0), path)
    return logs.read_lines(t.spark, path).select(
        "file_name",
        "turn",
        "role",
        F.md5("content").alias("content_md5"),
        F.col("timestamp").alias("ts"),
        F.col("embedding").isNotNull().alias("embedded"),
    )


@query(
    "chatlog_catalog",
    """select file_name, replace(left(file_name[5:], 13), '_', '') || ':' || file_name[19:20] || ':' || file_name[22:23] as created_at,
 count(*) as message_count, bool_or(embedded) as has_embeddings from fx_log group by 1, 2""",
    ("fx_log",),
)
def _chatlog_catalog(t: Tables):
    return logs.catalogue(_log(t))


@query("chatlog_latest", "select max(file_name) as file_name from fx_log", ("fx_log",))
def _chatlog_latest(t: Tables):
    return logs.latest(_log(t))


@query(
    "chatlog_restore",
    f"""select file_name, turn, 'restored' as session_id, role, {US.format(f"coalesce(strptime(ts, '%Y-%m-%dT%H:%M:%SZ'), timestamp '{AS_OF}')")} as at_us, embedded
from fx_log where role in ('user', 'assistant') and length(content) > 0""",
    ("fx_log",),
)
def _chatlog_restore(t: Tables):
    rows = logs.restored(_log(t), as_of())
    return rows.select(
        "file_name", "turn", "session_id", "role", F.unix_micros("at").alias("at_us"), F.col("embedding").isNotNull().alias("embedded")
    )


@query(
    "chatlog_restore_counts",
    "select file_name, count(*) as restored_count, count(*) filter (embedded) as embedding_count from fx_log group by 1",
    ("fx_log",),
)
def _chatlog_restore_counts(t: Tables):
    return logs.restore_counts(_log(t))


@query(
    "chatlog_export",
    f"""select file_name as title, cast(null as bigint) as turn, {US.format(f"case when min(conv) % 2 = 0 then timestamp '2023-12-31 00:00:00' else timestamp '{AS_OF}' end")} as created_us
from (select *, row_number() over (order by file_name) as x, cast(file_name[16:17] as bigint) * 60 + cast(file_name[19:20] as bigint) as conv from fx_log) group by 1
union all select file_name, turn, {US.format(f"coalesce(strptime(ts, '%Y-%m-%dT%H:%M:%SZ'), timestamp '{AS_OF}')")} from fx_log""",
    ("fx_log",),
)
def _chatlog_export(t: Tables):
    """Session and message rows when the files of even minutes were exported before."""
    log = _log(t)
    minute = F.regexp_extract("file_name", r"T\d\d-(\d\d)", 1).cast("int")
    known = log.filter(minute % 2 == 0).select(F.col("file_name").alias("title")).distinct()
    before = F.lit("2023-12-31").cast("timestamp")
    sessions, rows = logs.export(log, known.select("title", before.alias("created_at"), before.alias("updated_at")), as_of())
    heads = sessions.select("title", F.lit(None).cast("bigint").alias("turn"), F.unix_micros("created_at").alias("created_us"))
    return heads.unionByName(rows.select("title", "turn", F.unix_micros("created_at").alias("created_us")))


@query(
    "keyed_upsert",
    """select c.c_custkey, coalesce(o.o_totalprice, c.c_acctbal) as balance from customer c
left join (select o_custkey, max_by(o_totalprice, o_orderkey) as o_totalprice from orders group by 1) o on o.o_custkey = c.c_custkey
union all select o_custkey, max_by(o_totalprice, o_orderkey) from orders where o_custkey not in (select c_custkey from customer) group by 1""",
)
def _keyed_upsert(t: Tables):
    stored = t.read("customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    changes = t.read("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("balance"), "o_orderkey")
    return tables.upsert_latest(stored, changes, ["c_custkey"], "o_orderkey")


@query(
    "insert_missing",
    """select distinct l_orderkey as unit_id, l_suppkey as entity_id from lineitem l where not exists (select 1 from lineitem s
 where s.l_orderkey = l.l_orderkey and s.l_suppkey = l.l_suppkey and s.l_linenumber = 1)""",
)
def _insert_missing(t: Tables):
    """Bridge rows of all lines when those of the first lines are stored."""
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_suppkey").alias("entity_id"), "l_linenumber")
    stored = rows.filter(F.col("l_linenumber") == 1).drop("l_linenumber")
    return tables.insert_missing(stored, rows.drop("l_linenumber"), ["unit_id", "entity_id"])


@query(
    "delete_cascade",
    """select 'units' as kept, o_orderkey as id, count(*) as n from orders where o_custkey in (select c_custkey from customer where c_nationkey <> 3) group by 2
union all select 'unit_entities', l_orderkey, count(*) from lineitem where l_orderkey not in
 (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)) group by 2""",
)
def _delete_cascade(t: Tables):
    """Customers of one nation go, with their orders and order lines."""
    banks = t.read("customer").select(F.col("c_custkey").alias("bank_id"), "c_nationkey")
    owned = banks.select("bank_id")
    units = t.read("orders").select(F.col("o_custkey").alias("bank_id"), F.col("o_orderkey").alias("unit_id"))
    bridge = t.read("lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_suppkey").alias("entity_id"))
    stored = {"units": units.join(owned, "bank_id", "left_semi"), "unit_entities": bridge}
    left = tables.delete_banks(stored, banks.filter(F.col("c_nationkey") == 3))
    parts = [
        df.groupBy(F.lit(name).alias("kept"), F.col("unit_id").alias("id")).agg(F.count("*").alias("n"))
        for name, df in left.items()
    ]
    return parts[0].unionByName(parts[1])


# --- live payloads


@query(
    "comments_source",
    """select cast(event_id as varchar) as comment_id, 'u' || user_id as user_name, case when event_type = 'error' then '' else event_type end as comment from events""",
)
def _comments_source(t: Tables):
    kind = F.col("event_type")
    body = (
        F.when(kind == "error", '"snippet":{}')
        .when(kind == "purchase", '"snippet":{"textMessageDetails":{"messageText":""},"superChatDetails":{"userComment":"purchase"}}')
        .otherwise(F.concat(F.lit('"snippet":{"textMessageDetails":{"messageText":"'), kind, F.lit('"}}')))
    )
    payload = F.concat(
        F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('","authorDetails":{"displayName":"u'),
        F.col("user_id").cast("string"), F.lit('"},'), body, F.lit("}"),
    )
    return payloads.poll_comments(t.events.select("ts", payload.alias("payload"))).drop("ts", "icon")


@query(
    "comments_push",
    """select case when event_type = 'view' then null else cast(event_id as varchar) end as comment_id,
 case when event_type = 'error' then 'Unknown' else 'u' || user_id end as user_name, event_type as comment from events""",
)
def _comments_push(t: Tables):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    who = (
        F.when(kind == "error", '"nickname":""')
        .when(kind == "signup", F.concat(F.lit('"author":{"name":"u'), user, F.lit('"}')))
        .otherwise(F.concat(F.lit('"name":"u'), user, F.lit('"')))
    )
    ident = F.when(kind == "view", "").otherwise(F.concat(F.lit('"id":"'), F.col("event_id").cast("string"), F.lit('",')))
    field = F.when(kind == "click", "message").otherwise("comment")
    item = F.concat(F.lit("{"), ident, who, F.lit(',"'), field, F.lit('":"'), kind, F.lit('"}'))
    wrapped = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"data":'), item, F.lit("}"))).otherwise(item)
    return payloads.pushed_comments(t.events.select("ts", wrapped.alias("payload"))).drop("ts", "icon")


@query(
    "client_posts",
    """select cast(user_id as varchar) as client_id, event_id, 'direct_send' as type, cast(p as integer) as pos,
 case p when 0 then event_type else props end as message from events, (values (0), (1)) v(p)
where event_type <> 'error' and user_id > 0""",
)
def _client_posts(t: Tables):
    posts = t.events.select(
        F.when(F.col("user_id") > 0, F.col("user_id").cast("string")).otherwise("").alias("client_id"),
        F.col("event_id").alias("ts"),
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("system_prompt"),
        F.when(F.col("event_type") != "error", F.array("event_type", "props")).otherwise(F.array().cast("array<string>")).alias("messages"),
    )
    return payloads.client_posts(posts).withColumnRenamed("ts", "event_id").drop("system_prompt")


# --- messages

add_view(
    "fx_turns",
    """select user_id % 10 as conv_id, event_id as turn, case when event_type in ('click', 'view') then 'assistant'
 when event_type = 'error' then 'system' else 'user' end as role, case when event_type = 'signup' then null else event_id // 40 end as id,
 case when event_type = 'error' then '' else event_type end as content from events""",
)


def _turns(t: Tables):
    kind = F.col("event_type")
    role = F.when(kind.isin("click", "view"), "assistant").when(kind == "error", "system").otherwise("user")
    return t.events.select(
        (F.col("user_id") % 10).alias("conv_id"),
        F.col("event_id").alias("turn"),
        role.alias("role"),
        F.when(kind != "signup", F.floor(F.col("event_id") / 40).cast("bigint")).alias("id"),
        F.when(kind == "error", "").otherwise(kind).alias("content"),
    )


@query("msgs_text", "select conv_id, turn from fx_turns where length(content) > 0", ("fx_turns",))
def _msgs_text(t: Tables):
    return chatlog.text_messages(_turns(t)).select("conv_id", "turn")


@query(
    "msgs_audio",
    "select conv_id, turn from fx_turns where (role = 'system' and content <> '') or role = 'user' or (role = 'assistant' and content = 'click')",
    ("fx_turns",),
)
def _msgs_audio(t: Tables):
    audio = F.when(F.col("content") == "click", F.col("turn"))
    return chatlog.audio_messages(_turns(t).withColumn("audio", audio)).select("conv_id", "turn")


@query(
    "msg_text",
    """select conv_id, turn, md5(text || ' second') as joined_md5, md5(text) as first_md5,
 '[image data omitted]' as image, case when turn % 2 = 0 then '[audio data omitted]' end as audio from conversations""",
)
def _msg_text(t: Tables):
    none = F.lit(None).cast("string")

    def part(kind, text, image):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), image.alias("image"))

    parts = F.array(part("text", F.col("text"), none), part("image", none, F.lit("data:")), part("text", F.lit("second"), none))
    return t.read("conversations").select(
        "conv_id",
        "turn",
        F.md5(chat.text_parts(parts)).alias("joined_md5"),
        F.md5(chat.display_text(parts)).alias("first_md5"),
        chat.stored_parts(parts)[1]["image"].alias("image"),
        chat.stored_audio(F.when(F.col("turn") % 2 == 0, F.col("turn"))).alias("audio"),
    )


add_view(
    "fx_runs",
    """select *, sum(case when role = prole and id = pid then 0 else 1 end) over (partition by conv_id order by turn) as run from (
 select *, lag(role) over (partition by conv_id order by turn) as prole, lag(id) over (partition by conv_id order by turn) as pid from fx_turns)""",
    "fx_turns",
)


@query(
    "msg_normalize",
    """select conv_id, min(turn) as turn, any_value(role) as role, any_value(id) as id, string_agg(content, ' ' order by turn) as content
from fx_runs group by conv_id, run having string_agg(content, ' ' order by turn) <> ''""",
    ("fx_runs",),
)
def _msg_normalize(t: Tables):
    return chatlog.normalize(_turns(t))


LAST_SQL = """, recent as (select * from (select *, row_number() over (partition by conv_id order by turn desc) as rn from {0} where role in ('user', 'assistant')) where rn <= 10),
marked as (select *, case when role = lag(role) over (partition by conv_id order by turn) then 0 else 1 end as new from recent),
runs as (select *, sum(new) over (partition by conv_id order by turn) as run from marked),
merged as (select conv_id, run, any_value(role) as role, string_agg(coalesce(content, ''), chr(10) order by turn) as content from runs group by 1, 2),
kept as (select * from merged where run > 1 or role = 'user'),
closed as (select * from kept union all select c.conv_id, coalesce(l.run, 0) + 1, 'user', 'CONTINUE' from (select distinct conv_id from {0}) c
 left join (select conv_id, max_by(role, run) as role, max(run) as run from kept group by 1) l on l.conv_id = c.conv_id where coalesce(l.role, 'assistant') = 'assistant')
select conv_id, row_number() over (partition by conv_id order by run) as pos, role, md5(content) as content_md5 from closed"""


def _with_pos(df):
    return df.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "role", F.md5("content").alias("content_md5"))


@query("last_messages", LAST_SQL.format("fx_turns"), ("fx_turns",))
def _last_messages(t: Tables):
    return _with_pos(chatlog.last_messages(_turns(t)))


@query("last_messages_conversations", LAST_SQL.format("fx_messages"), ("fx_messages",))
def _last_messages_conversations(t: Tables):
    return _with_pos(chatlog.last_messages(t.messages))


@query(
    "processed_messages",
    """select conv_id, turn, role, '[' || turn || '] ' || case when role = 'user' then '[u' || conv_id || 'さんのコメント] ' else '' end || content as content,
 case when rn = 1 then 'img' end as image from (select *, row_number() over (partition by conv_id order by turn desc) as rn from fx_turns) where rn <= 10""",
    ("fx_turns",),
)
def _processed_messages(t: Tables):
    rows = _turns(t).withColumns(
        {
            "user_name": F.concat(F.lit("u"), F.col("conv_id").cast("string")),
            "timestamp": F.col("turn").cast("string"),
            "image": F.lit("img"),
        }
    )
    return chatlog.processed_messages(rows)


@query(
    "latest_assistant",
    "select conv_id, md5(coalesce(max_by(text, turn) filter (role = 'assistant'), '')) as content_md5 from conversations group by 1",
)
def _latest_assistant(t: Tables):
    return chatlog.latest_assistant(t.messages).select("conv_id", F.md5("content").alias("content_md5"))


@query("memory_records", "select conv_id, turn from conversations where role in ('user', 'assistant') and length(text) > 0")
def _memory_records(t: Tables):
    return chatlog.memory_records(t.messages).select("conv_id", "turn")


@query(
    "msg_upsert",
    """with c as (select user_id as id, event_id as pos, case when event_type <> 'view' then event_type end as role,
 case when event_type <> 'error' then cast(event_id as varchar) end as content from events),
born as (select id, min(pos) as b from c where role is not null and content is not null group by 1)
select c.id, max_by(role, pos) filter (role is not null) as role, max_by(content, pos) filter (content is not null) as content
from c join born on born.id = c.id where c.pos >= born.b group by 1""",
)
def _msg_upsert(t: Tables):
    kind = F.col("event_type")
    changes = t.events.select(
        F.col("user_id").alias("id"),
        F.when(kind != "view", kind).alias("role"),
        F.when(kind != "error", F.col("event_id").cast("string")).alias("content"),
        F.col("event_id").alias("at"),
    )
    return chatlog.upsert(changes.drop("at").limit(0), changes, ["id"], "at", ["role", "content"])


@query("msg_diff", "select conv_id, turn from conversations where turn > 4 or turn % 2 = 1")
def _msg_diff(t: Tables):
    edited = F.when(F.col("turn") % 2 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    previous = t.messages.filter(F.col("turn") <= 4)
    return chatlog.diff(previous, t.messages.withColumn("content", edited), ["conv_id", "turn"]).select("conv_id", "turn")


@query(
    "transcript",
    """select conv_id, md5(string_agg(role || ': ' || text, chr(10) order by turn)) as transcript_md5 from (
 select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn <= 10 group by 1""",
)
def _transcript(t: Tables):
    return chatlog.transcript(t.messages).select("conv_id", F.md5("transcript").alias("transcript_md5"))


add_view(
    "fx_context",
    """select query_id, record_id, rn, strftime(timestamp '2024-01-01 00:00:00' + record_id * interval '1' minute + interval '9' hour, '[%Y/%m/%d %H:%M]')
  || ' ' || case when record_id % 2 = 0 then 'ユーザー' else 'キャラクター' end || ': ' || word || repeat(word, cast(record_id % 60 as integer)) as line from (
 select a.vec_id as query_id, b.vec_id as record_id, 'memory ' as word,
  row_number() over (partition by a.vec_id order by round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 9) desc, b.vec_id) as rn
 from embeddings a join embeddings b on round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 9) >= 0.2) where rn <= 5""",
)


def _header_tokens() -> int:
    japanese = sum("\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9faf" for c in chat.CONTEXT_HEADER)
    ascii_ = sum(c < "\x80" for c in chat.CONTEXT_HEADER)
    return math.ceil(japanese / 1.5) + math.ceil(ascii_ / 4) + len(chat.CONTEXT_HEADER) - japanese - ascii_


ROOM = 200 - _header_tokens()


@query(
    "context_build",
    f""", costed as (select *, ceil(length(regexp_replace(line || chr(10), '[^ぁ-ヿ一-龯]', '', 'g')) / 1.5)
 + ceil(length(regexp_replace(line || chr(10), '[^\\x00-\\x7F]', '', 'g')) / 4.0) as cost,
 row_number() over (partition by query_id order by record_id desc) as back from fx_context),
walk as (select distinct query_id, cast(0 as bigint) as back, 0.0::double as used, '' as kept from costed
 union all select w.query_id, c.back, case when w.used + c.cost <= {ROOM} then w.used + c.cost else w.used end,
 case when w.used + c.cost <= {ROOM} then c.line || case when w.kept = '' then '' else chr(10) || w.kept end else w.kept end
 from walk w join costed c on c.query_id = w.query_id and c.back = w.back + 1)
select query_id, case when max_by(kept, back) = '' then '' else '{chat.CONTEXT_HEADER}' || max_by(kept, back) end as context from walk group by 1""",
    ("fx_context",),
)
def _context_build(t: Tables):
    records = t.read("embeddings").select(F.col("vec_id").alias("record_id"), "embedding")
    found = search.memory_search(t.probes, records, threshold=0.2)
    record = F.col("record_id")
    at = F.timestamp_seconds(F.lit(1704067200) + record * 60)
    word = F.lit("memory ")
    rows = found.select(
        "query_id",
        F.col("rn").alias("rank"),
        F.when(record % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(word, F.repeat(word, (record % 60).cast("int"))).alias("content"),
        format_ts(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("stamp"),
        record.alias("turn"),
    )
    return chatlog.context_build(rows, max_tokens=200)


@query("utterances")
def _utterances(t: Tables):
    return chatlog.utterances(t.read("conversations").select("conv_id", "turn", "text"))


# --- live streams


@query(
    "comments_clean",
    "select comment_id from fx_comments where comment <> '' and comment not like '#%'",
    ("fx_comments",),
)
def _comments_clean(t: Tables):
    return live.clean_comments(t.comments).select("comment_id")


@query(
    "comments_dedup",
    "select user_id as comment_id, min(event_id) as first_event from events where user_id % 50 <> 0 group by 1 union all select null, event_id from events where user_id % 50 = 0",
)
def _comments_dedup(t: Tables):
    ident = F.when(F.col("user_id") % 50 != 0, F.col("user_id"))
    rows = t.events.select(ident.alias("comment_id"), F.col("event_id").alias("ts"))
    return live.dedup_comments(rows).withColumnRenamed("ts", "first_event")


TICK_SQL = "epoch_us(ts) // 600000000"


def _ticks(t: Tables):
    return live.ticked(live.clean_comments(t.comments), 600)


@query(
    "comments_tick",
    f"select channel_id, {TICK_SQL} as tick, comment_id from fx_comments where comment <> '' and comment not like '#%'",
    ("fx_comments",),
)
def _comments_tick(t: Tables):
    return _ticks(t).select("channel_id", "tick", "comment_id")


add_view(
    "fx_picked",
    f"""select channel_id, {TICK_SQL} as tick, max_by(comment_id, md5('s' || comment_id)) as comment_id, max_by(comment, md5('s' || comment_id)) as comment
from fx_comments where comment <> '' and comment not like '#%' group by 1, 2""",
    "fx_comments",
)


@query("comment_sample", "select * from fx_picked", ("fx_picked",))
def _comment_sample(t: Tables):
    return live.sample_comment(_ticks(t), "s")


@query(
    "comment_match",
    f"""select c.channel_id, c.tick, c.comment_id, c.comment from (select *, {TICK_SQL} as tick from fx_comments where comment <> '' and comment not like '#%') c
join fx_picked p on p.channel_id = c.channel_id and p.tick = c.tick qualify row_number() over (partition by c.channel_id, c.tick order by
 case when c.comment = left(p.comment, 9) then 0 when contains(left(p.comment, 9), c.comment) or contains(c.comment, left(p.comment, 9)) then 1 else 2 end, c.comment_id) = 1""",
    ("fx_picked",),
)
def _comment_match(t: Tables):
    picked = live.sample_comment(_ticks(t), "s")
    said = F.concat(F.lit("「\""), F.left("comment", F.lit(9)), F.lit("\"」"))
    answers = picked.select("channel_id", "tick", said.alias("answer"))
    return chatlog.comment_match(answers, _ticks(t))


@query(
    "continuity_state",
    f""", busy as (select distinct channel_id, {TICK_SQL} as tick from fx_comments where comment <> '' and comment not like '#%'),
gaps as (select *, coalesce(lag(tick) over (partition by channel_id order by tick), tick - 1) as since from busy),
ticks as (select channel_id, tick as busy, since, unnest(range(since + 1, tick + 1)) as tick from gaps),
counted as (select channel_id, tick, tick = busy as answered, case when tick = busy then 0 else tick - since end as n from ticks)
select channel_id, tick, n as no_comment_count, case when answered then 'send_comment' when n > 6 then 'do_nothing' when n = 6 then 'sleep' else 'process_messages' end as action,
 n >= 6 as sleep_mode from counted""",
    ("fx_comments",),
)
def _continuity_state(t: Tables):
    return live.continuity(_ticks(t))


@query(
    "client_queue",
    """with ops as (select user_id as client_id, event_id as seq, epoch_us(ts) as us, case when event_type in ('view', 'purchase') then 'read' else 'post' end as op from events),
p as (select *, lag(us) over w as pus, lag(op) over w as pop from ops window w as (partition by client_id order by us, seq)),
r as (select p.*, pus is null or pop = 'read' or (us - pus > 300000000 and exists (select 1 from ops o where o.op = 'post' and o.us > p.pus + 300000000 and o.us <= p.us)) as fresh from p),
runs as (select *, sum(case when fresh then 1 else 0 end) over (partition by client_id order by us, seq) as run from r)
select a.client_id, a.seq, b.seq as delivered_seq from runs a left join runs b on b.client_id = a.client_id and b.run = a.run and b.op = 'read' where a.op = 'post'""",
)
def _client_queue(t: Tables):
    op = F.when(F.col("event_type").isin("view", "purchase"), "read").otherwise("post")
    return live.client_queue(t.events.select(F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), "ts", op.alias("op")))


IDLE_SQL = """select channel_id, pus as since_us, unnest(range(1, (us - pus) // 300000000 + 1)) as n from (
 select user_id % 10 as channel_id, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id % 10 order by ts, event_id) as pus from events)
where us - pus >= 300000000"""


def _idle(t: Tables):
    activity = t.events.select((F.col("user_id") % 10).alias("channel_id"), "ts", F.col("event_id").alias("seq"))
    return live.idle_gaps(activity, 300)


@query("idle_gaps", f"select *, since_us + n * 300000000 as fire_us from ({IDLE_SQL})")
def _idle_gaps(t: Tables):
    return _idle(t)


@query(
    "phrase_rotation",
    f"""select *, case (row_number() over (partition by channel_id order by since_us + n * 300000000) - 1) % 3 when 0 then 'a' when 1 then 'b' else 'c' end as phrase,
 since_us + n * 300000000 as fire_us from ({IDLE_SQL})""",
)
def _phrase_rotation(t: Tables):
    return live.rotate_phrases(_idle(t), ["a", "b", "c"])


@query(
    "silence_segments",
    """with p as (select user_id % 10 as device_id, event_id as seq, epoch_us(ts) as us, event_type as text,
 lag(epoch_us(ts)) over (partition by user_id % 10 order by ts, event_id) as pus from events),
r as (select *, sum(case when pus is null or us - pus >= 1200000000 then 1 else 0 end) over (partition by device_id order by us, seq) as run from p)
select device_id, min(us) as start_us, max(us) as end_us, count(*) as pieces, string_agg(text, ' ' order by us, seq) as transcript from r group by device_id, run""",
)
def _silence_segments(t: Tables):
    speech = t.events.select(
        (F.col("user_id") % 10).alias("device_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("text")
    )
    return live.silence_segments(speech, 1200)


@query("presence_intervals")
def _presence_intervals(t: Tables):
    return live.presence(t.detections, 600, 1800, 3600)


add_view(
    "fx_chunks",
    """select user_id % 10 as stream_id, event_id as seq, case event_type when 'purchase' then 'console' when 'signup' then 'user' else 'assistant' end as role,
 case event_type when 'error' then 'end' when 'view' then case when user_id % 7 = 0 then 'start' end end as type, event_type || ' ' as text from events""",
)


def _chunks(t: Tables):
    kind = F.col("event_type")
    return t.events.select(
        (F.col("user_id") % 10).alias("stream_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "purchase", "console").when(kind == "signup", "user").otherwise("assistant").alias("role"),
        F.when(kind == "error", "end").when((kind == "view") & (F.col("user_id") % 7 == 0), "start").alias("type"),
        F.concat(kind, F.lit(" ")).alias("text"),
    )


@query(
    "chunk_assemble",
    """, c as (select stream_id, seq, case when role = 'console' then 'code' else role end as role, type, text from fx_chunks where role <> 'user'),
p as (select *, lag(role) over w as prole, lag(type) over w as ptype from c window w as (partition by stream_id order by seq)),
r as (select *, sum(case when prole = role and coalesce(ptype, '') not in ('start', 'end') and coalesce(type, '') <> 'start' then 0 else 1 end)
 over (partition by stream_id order by seq) as run from p)
select stream_id, min(seq) as seq, any_value(role) as role, string_agg(text, '' order by seq) filter (coalesce(type, '') <> 'start') as text
from r group by stream_id, run having count(*) filter (coalesce(type, '') <> 'start') > 0""",
    ("fx_chunks",),
)
def _chunk_assemble(t: Tables):
    return chatlog.assemble_chunks(_chunks(t))


@query(
    "stream_split",
    """select event_id // 20 as message_id, coalesce(string_agg(event_type, '' order by event_id) filter (event_type <> 'view'), '') as content,
 coalesce(string_agg(cast(user_id as varchar), '' order by event_id) filter (event_type = 'view'), '') as thinking from events group by 1""",
)
def _stream_split(t: Tables):
    thinking = F.concat(F.lit(chatlog.THINKING_MARKER), F.col("user_id").cast("string"))
    text = F.when(F.col("event_type") == "view", thinking).otherwise(F.col("event_type"))
    chunks = t.events.select(F.floor(F.col("event_id") / 20).cast("bigint").alias("message_id"), F.col("event_id").alias("seq"), text.alias("text"))
    return chatlog.split_stream(chunks)
