"""Queries over the scalar functions, predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis.catalog import query
from anamnesis.catalog.fixtures import AS_OF, Tables, as_of, sim_sql
from anamnesis.functions import dates, facts, guidance, tags, text, timeparse, vector

US = "cast(epoch_us({}) as bigint)"


@query(
    "cosine",
    f"""select a.unit_id, {sim_sql("a.embedding", "b.embedding")} as similarity
from fx_units a join fx_units b on b.unit_id = a.unit_id + 5""",
    ("fx_units",),
)
def _cosine(t: Tables):
    a = t.units.select("unit_id", "embedding")
    b = t.units.select((F.col("unit_id") - 5).alias("unit_id"), F.col("embedding").alias("other"))
    return a.join(b, "unit_id").select(
        "unit_id", vector.cosine(F.col("embedding"), F.col("other")).alias("similarity")
    )


GRAMS_SQL = (
    "case when trim({0}) = '' then [] else list_distinct(list_transform(list_zip(string_split({1}, '')[:-2], "
    "string_split({1}, '')[2:]), lambda x: x[1] || x[2])) end"
)


def bigrams_sql(column: str) -> str:
    """SQL for the distinct bigrams of a column."""
    squeezed = f"trim(regexp_replace({column}, '[ \\t\\n\\f\\r\\x0b]+', ' ', 'g'))"
    return GRAMS_SQL.format(squeezed, f"(' ' || {squeezed} || ' ')")


@query(
    "bigram_similarity",
    f"""with g as (select doc_id, {bigrams_sql("text")} as grams from documents)
select a.doc_id, round(len(list_intersect(a.grams, b.grams)) / greatest(len(a.grams), len(b.grams)), 6) as similarity
from g a join g b on b.doc_id = a.doc_id + 1""",
)
def _bigram_similarity(t: Tables):
    grams = t.read("documents").select("doc_id", text.bigrams(F.col("text")).alias("grams"))
    # each document meets its successor without its pairs being cut twice
    slots = F.explode(F.array(F.col("doc_id"), F.col("doc_id") - 1)).alias("slot")
    pairs = grams.select("doc_id", "grams", slots).groupBy("slot").agg(
        F.min_by("grams", "doc_id").alias("a"), F.max_by("grams", "doc_id").alias("b"), F.count("*").alias("n")
    )
    score = F.round(text.gram_overlap(F.col("a"), F.col("b")), 6)
    return pairs.filter("n = 2").select(F.col("slot").alias("doc_id"), score.alias("similarity"))


def trigrams_sql(column: str) -> str:
    """SQL for the distinct trigrams of a column."""
    words = f"list_filter(regexp_split_to_array(lower({column}), '[^\\pL\\pN]+'), lambda w: len(w) > 0)"
    chars = "string_split('  ' || w || ' ', '')"
    triples = f"list_transform(list_zip({chars}[:-3], {chars}[2:-2], {chars}[3:]), lambda x: x[1] || x[2] || x[3])"
    return f"list_distinct(flatten(list_transform({words}, lambda w: {triples})))"


@query(
    "trigram_similarity",
    f"""with g as (select p_partkey, {trigrams_sql("p_name")} as a, {trigrams_sql("p_brand || ' ' || p_type")} as b from part)
select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as similarity from g""",
)
def _trigram_similarity(t: Tables):
    other = F.concat("p_brand", F.lit(" "), "p_type")
    score = F.round(text.trigram_similarity(F.col("p_name"), other), 6)
    return t.read("part").select("p_partkey", score.alias("similarity"))


@query(
    "extract_keywords",
    r"""with tokens as (select conv_id, turn, text,
 list_filter(regexp_split_to_array(text, '[はがのをにでともやへか\s\p{Z}]+'), lambda k: length(k) >= 2) as kept from conversations)
select distinct conv_id, turn, unnest(case when len(kept) > 0 then kept when length(text) <= 20 then [text] else [] end) as keyword
from tokens""",
)
def _extract_keywords(t: Tables):
    keywords = F.explode(text.extract_keywords(F.col("text")))
    return t.read("conversations").select("conv_id", "turn", keywords.alias("keyword"))


PHRASE_SQL = """case event_type when 'click' then cast(user_id as varchar) || '日前の話'
 when 'view' then '先月の出来事' when 'purchase' then '2023年' || cast(user_id % 15 as varchar) || '月の記録'
 when 'signup' then '先週の水曜日に来た' else 'no date at all' end"""


@query(
    "time_range",
    """with d as (select event_id, event_type, user_id, date_trunc('day', ts) as today from events), r as (
select event_id, case event_type when 'click' then today - least(user_id, 3650) * interval '1' day
 when 'view' then date_trunc('month', today) - interval '1' month
 when 'purchase' then case when user_id % 15 between 1 and 12
   then make_timestamp(2023, user_id % 15, 1, 0, 0, 0.0) else case when user_id % 15 = 0 or user_id % 15 > 12 then null end end
 when 'signup' then date_trunc('week', today) - interval '5' day end as a,
 case event_type when 'click' then today when 'view' then date_trunc('month', today)
 when 'purchase' then case when user_id % 15 between 1 and 12
   then make_timestamp(2023, user_id % 15, 1, 0, 0, 0.0) + interval '1' month end
 when 'signup' then date_trunc('week', today) - interval '4' day end as b from d)
select event_id, cast(epoch_us(a) as bigint) as start_us, cast(epoch_us(b) as bigint) as end_us from r""",
)
def _time_range(t: Tables):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    phrase = (
        F.when(kind == "click", F.concat(user, F.lit("日前の話")))
        .when(kind == "view", "先月の出来事")
        .when(kind == "purchase", F.concat(F.lit("2023年"), (F.col("user_id") % 15).cast("string"), F.lit("月の記録")))
        .when(kind == "signup", "先週の水曜日に来た")
        .otherwise("no date at all")
    )
    span = t.events.select("event_id", timeparse.time_range(phrase, F.col("ts")).alias("r"))
    return span.select(
        "event_id", F.unix_micros("r.start").alias("start_us"), F.unix_micros("r.end").alias("end_us")
    )


@query(
    "estimate_tokens",
    r"""with c as (select doc_id, text, length(regexp_replace(text, '[^\x{3040}-\x{30FF}\x{4E00}-\x{9FAF}]', '', 'g')) as jp,
 length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) as asc_n,
 length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) as units from documents)
select doc_id, cast(case when length(text) = 0 then 0 else greatest(1, ceil(jp / 1.5) + ceil(asc_n / 4.0) + units - jp - asc_n) end as bigint) as tokens
from c""",
)
def _estimate_tokens(t: Tables):
    return t.read("documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "format_ts",
    "select event_id, case when event_type = 'error' then '[不明]' else strftime(ts + interval '9' hour, '[%Y/%m/%d %H:%M]') end as label from events",
)
def _format_ts(t: Tables):
    iso = F.when(F.col("event_type") == "error", "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.events.select("event_id", dates.format_ts(iso).alias("label"))


@query(
    "json_array_salvage",
    """select event_id, case event_type when 'error' then '[]' else '[' || props || ', [1, 2]]' end as salvaged,
 cast(case event_type when 'error' then 0 else 2 end as bigint) as items from events""",
)
def _json_array_salvage(t: Tables):
    array = F.concat(F.lit("["), "props", F.lit(", [1, 2]]"))
    answer = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("no array ["), "props"))
        .when(F.col("event_type") == "view", array)
        .otherwise(F.concat(F.lit("Here you are: "), array, F.lit(" - done [x]")))
    )
    salvaged = text.salvage_json_array(answer)
    return t.events.select("event_id", salvaged.alias("salvaged")).withColumn(
        "items", F.json_array_length("salvaged").cast("bigint")
    )


BEST_DATE_SQL = """coalesce(case when {0}occurred_start is not null and {0}occurred_end is not null
 then {0}occurred_start + ({0}occurred_end - {0}occurred_start) / 2 end, {0}occurred_start, {0}occurred_end, {0}mentioned_at, {0}event_date)"""


@query(
    "best_date",
    f"""select unit_id, {US.format(BEST_DATE_SQL.format(""))} as best_us,
 {US.format("coalesce(event_date, occurred_start, mentioned_at)")} as event_us from fx_units""",
    ("fx_units",),
)
def _best_date(t: Tables):
    best = dates.best_date(*[F.col(c) for c in ("occurred_start", "occurred_end", "mentioned_at", "event_date")])
    event = dates.best_event_time(*[F.col(c) for c in ("event_date", "occurred_start", "mentioned_at")])
    return t.units.select("unit_id", F.unix_micros(best).alias("best_us"), F.unix_micros(event).alias("event_us"))


@query(
    "temporal_proximity",
    """select event_id, round(greatest(0, 1 - abs(epoch_us(ts) - epoch_us(timestamp '2024-01-16 00:00:00')) / 86400e6 / 15), 6) as proximity
from events""",
)
def _temporal_proximity(t: Tables):
    start, end = (F.lit(d).cast("timestamp") for d in ("2024-01-01", "2024-01-31"))
    score = dates.temporal_proximity(F.col("ts"), start, end)
    return t.events.select("event_id", F.round(score, 6).alias("proximity"))


@query(
    "recency",
    f"""select o_orderkey, round(greatest(0, 1 - greatest(0, (epoch_us(timestamp '{AS_OF}') - epoch_us(o_orderdate)) / 86400e6) / 365), 6) as recency
from orders""",
)
def _recency(t: Tables):
    created = F.col("o_orderdate").cast("timestamp")
    score = F.round(dates.recency(created, as_of()), 6)
    return t.read("orders").select("o_orderkey", score.alias("recency"))


@query(
    "event_bucket",
    """select event_id, cast(epoch_us(date_trunc('day', ts)) + case when hour(ts) >= 12 then 43200000000 else 0 end as bigint) as bucket_us,
 case when hour(ts) between 5 and 10 then 'morning' when hour(ts) between 11 and 16 then 'afternoon' else 'evening' end as period
from events""",
)
def _event_bucket(t: Tables):
    bucket = F.unix_micros(dates.event_bucket(F.col("ts")))
    return t.events.select(
        "event_id", bucket.alias("bucket_us"), dates.time_period(F.col("ts")).alias("period")
    )


@query(
    "link_weight",
    """select o_orderkey, l_linenumber, round(greatest(0.3, 1 - abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600e6 / 24), 6) as weight
from orders join lineitem on l_orderkey = o_orderkey""",
)
def _link_weight(t: Tables):
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    weight = dates.link_weight(F.col("l_shipdate").cast("timestamp"), F.col("o_orderdate").cast("timestamp"))
    return (
        t.read("orders")
        .join(lines, "o_orderkey")
        .select("o_orderkey", "l_linenumber", F.round(weight, 6).alias("weight"))
    )


@query(
    "is_stale",
    f"""select model_id, coalesce(floor((epoch_us(timestamp '{AS_OF}') - epoch_us(last_refreshed_at)) / 86400e6) >= 7, true) as is_stale
from fx_models""",
    ("fx_models",),
)
def _is_stale(t: Tables):
    return t.models.select("model_id", dates.is_stale(F.col("last_refreshed_at"), as_of()).alias("is_stale"))


@query(
    "rerank_doc",
    """select unit_id, md5(coalesce('[Date: ' || strftime(occurred_start, '%Y-%m-%d') || '] ', '')
  || case when length(context) > 0 then context || ': ' else '' end || text) as rerank_md5,
 md5(text || coalesce(' (happened on ' || strftime(event_date, '%Y-%m-%d') || ')', '')) as embedding_md5 from fx_units""",
    ("fx_units",),
)
def _rerank_doc(t: Tables):
    rerank = text.rerank_text(F.col("text"), F.col("context"), F.col("occurred_start"))
    embed = text.embedding_text(F.col("text"), F.col("event_date"))
    return t.units.select("unit_id", F.md5(rerank).alias("rerank_md5"), F.md5(embed).alias("embedding_md5"))


@query(
    "emotion_tag",
    """select event_id, case when event_type = 'error' then 'neutral' when event_type = 'view' then 'happy' else event_type end as emotion,
 case when event_type = 'error' then 'no tag ' || cast(user_id as varchar) else 'said [x] ' || cast(user_id as varchar) end as body,
 case when event_type = 'view' then 'happy' else 'neutral' end as idle_emotion,
 case when event_type = 'error' then 'no tag ' || cast(user_id as varchar) else 'said  ' || cast(user_id as varchar) end as idle_body
from events""",
)
def _emotion_tag(t: Tables):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    tag = F.when(kind == "view", "Happy").otherwise(kind)
    line = F.when(kind == "error", F.concat(F.lit("no tag "), user)).otherwise(
        F.concat(F.lit(" ["), tag, F.lit("] said [x] "), user)
    )
    found = t.events.select("event_id", text.emotion_tag(line).alias("e"), text.idle_phrase(line).alias("i"))
    return found.select(
        "event_id",
        "e.emotion",
        "e.body",
        F.col("i.emotion").alias("idle_emotion"),
        F.col("i.body").alias("idle_body"),
    )


@query(
    "split_sentences",
    r"""with s as (select doc_id, regexp_extract_all(text, '[^。．！？\n]*[。．！？\n]|[^。．！？\n]+') as parts from documents),
n as (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from s)
select doc_id, cast(i - 1 as bigint) as pos, md5(parts[i]) as sentence_md5 from n""",
)
def _split_sentences(t: Tables):
    parts = t.read("documents").select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "s"))
    return parts.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("s").alias("sentence_md5"))


@query(
    "clean_text",
    r"""with c as (select doc_id, regexp_replace(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'),
 '[\x{1F300}-\x{1F9FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F1E0}-\x{1F1FF}]', '', 'g') as bare from documents)
select doc_id, case when bare <> '' and not regexp_full_match(bare, '[\pP\pS 　]+') then md5(bare) end as cleaned_md5 from c""",
)
def _clean_text(t: Tables):
    return t.read("documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned_md5"))


READINGS = {"the": "ザ", "data": "データ", "and": "アンド", "in": "イン"}


@query(
    "dict_substitute",
    r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bthe\b', 'ザ', 'gi'),
 '\bdata\b', 'データ', 'gi'), '\band\b', 'アンド', 'gi'), '\bin\b', 'イン', 'gi')) as read_md5 from documents""",
)
def _dict_substitute(t: Tables):
    return t.read("documents").select("doc_id", F.md5(text.substitute_terms(F.col("text"), READINGS)).alias("read_md5"))


@query(
    "input_validate",
    """select conv_id, turn, case when length(text) > 200 then 'too_long'
 when lower(text) like '%une%' or lower(text) like '%der die%' then 'blocked_word' end as problem from conversations""",
)
def _input_validate(t: Tables):
    blocked = text.parse_word_list(F.lit("Une, , der die"))
    return t.read("conversations").select(
        "conv_id", "turn", text.input_problem(F.col("text"), blocked).alias("problem")
    )


VISIBLE_SQL = {
    "any": "own is null or list_has_any(own, wanted)",
    "all": "own is null or list_has_all(own, wanted)",
    "any_strict": "own is not null and list_has_any(own, wanted)",
    "all_strict": "own is not null and list_has_all(own, wanted)",
}


def _register_visibility(mode: str) -> None:
    sql = f"""with w as (select u.unit_id, (select list(tag) from fx_unit_tags x where x.unit_id = u.unit_id) as own,
 ['click', 'lang_a'] as wanted from fx_units u) select unit_id from w where {VISIBLE_SQL[mode]}"""

    @query(f"visibility_{mode}", sql.replace("with w as", ", w as", 1), ("fx_units", "fx_unit_tags"))
    def _visibility(t: Tables):
        wanted = F.array(F.lit("click"), F.lit("lang_a"))
        return t.tagged_units.filter(tags.visible(F.col("tags"), wanted, mode)).select("unit_id")


for _mode in tags.MATCH_MODES:
    _register_visibility(_mode)


def _guidance_case(axis_sql: str, texts: tuple[str, str]) -> str:
    return f"case when {axis_sql} >= 4 then '{texts[0]}' when {axis_sql} <= 2 then '{texts[1]}' end"


_AXES_SQL = {
    "skepticism": "greatest(1, least(5, c_custkey % 9 - 1))",
    "literalism": "3",
    "empathy": "greatest(1, least(5, c_nationkey % 6))",
}


@query(
    "disposition_guidance",
    f"""select c_custkey, array_to_string(list_filter([{", ".join(_guidance_case(_AXES_SQL[a], g) for a, g in guidance.GUIDANCE.items())}],
 lambda x: x is not null), '|') as lines from customer""",
)
def _disposition_guidance(t: Tables):
    skepticism = (F.col("c_custkey") % 9 - 1).cast("string")
    lines = guidance.guidance_lines(skepticism, F.lit("not a number"), (F.col("c_nationkey") % 6).cast("string"))
    return t.read("customer").select("c_custkey", F.array_join(lines, "|").alias("lines"))


@query(
    "directives_clean",
    f"""select p_partkey, '{guidance.DIRECTIVE_HEAD}' || '1. ' || p_name || chr(10) || '2. ' || p_brand || '{guidance.DIRECTIVE_FOOT}' as section,
 '{guidance.REMINDER_HEAD}' || '  1. ' || p_name || chr(10) || '  2. ' || p_brand || chr(10) as reminder from part""",
)
def _directives_clean(t: Tables):
    directives = F.array("p_name", F.lit(" \n"), "p_brand", F.lit(""))
    return t.read("part").select(
        "p_partkey",
        guidance.directive_section(directives).alias("section"),
        guidance.directive_reminder(directives).alias("reminder"),
    )


@query(
    "source_query",
    """select s_suppkey, case when s_nationkey % 2 = 0 then s_name || 'について、これまでの全ての記憶から包括的にまとめてください。'
 || 'ミッション「trade」の観点を含めてください。' else s_name || 'について、これまでの全ての記憶から包括的にまとめてください。' end as question from supplier""",
)
def _source_query(t: Tables):
    mission = F.when(F.col("s_nationkey") % 2 == 0, "trade").otherwise("")
    return t.read("supplier").select("s_suppkey", guidance.source_query(F.col("s_name"), mission).alias("question"))


@query(
    "valid_ids",
    "select event_id, cast(2 as bigint) as n_valid, md5(cast(event_id as varchar)) as first_id from events",
)
def _valid_ids(t: Tables):
    digest = F.md5(F.col("event_id").cast("string"))
    dashed = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    asked = F.concat(F.array(digest, F.lit("bad"), dashed), F.array_repeat(F.lit("?"), 7), F.array(digest))
    ids = tags.valid_ids(asked)
    return t.events.select("event_id", F.size(ids).cast("bigint").alias("n_valid"), ids[0].alias("first_id"))


@query(
    "facts_validate",
    """select event_id, case when event_type in ('event') then event_type else 'conversation' end as fact_kind,
 case when event_type = 'view' then 'experience' else 'world' end as fact_type,
 case when event_type <> 'click' then cast(epoch_us(date_trunc('second', ts)) as bigint) end as event_us
from events where event_type <> 'error'""",
)
def _facts_validate(t: Tables):
    kind = F.col("event_type")
    raw = t.events.select(
        "event_id",
        F.when(kind == "error", "").otherwise(kind).alias("text"),
        kind.alias("fact_kind"),
        F.when(kind == "view", "experience").otherwise(kind).alias("fact_type"),
        F.when(kind == "click", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("event_date"),
    )
    kept = facts.validate_facts(raw)
    return kept.select("event_id", "fact_kind", "fact_type", F.unix_micros("event_date").alias("event_us"))


@query(
    "actions_validate",
    """select event_id from events where event_type = 'click' or (event_type = 'view' and user_id % 2 = 0)""",
)
def _actions_validate(t: Tables):
    kind = F.col("event_type")
    action = F.when(kind == "click", "create").when(kind.isin("view", "signup"), "update").otherwise("delete")
    actions = t.events.select(
        "event_id",
        action.alias("action"),
        F.when(kind != "signup", kind).alias("text"),
        F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("learning_id"),
    )
    return facts.validate_actions(actions).select("event_id")
