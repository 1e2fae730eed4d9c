"""Hand-made cases of the scalar rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from anamnesis.functions import chat, dates, guidance, tags, text, timeparse, vector
from anamnesis.operators import chatlog, entities, freshness
from anamnesis.streaming import live as streams


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize(
    "a, b, expected",
    [((1, 2), (1, 2), 1.0), ((1, 0), (-1, 0), -1.0), ((1, 0), (0, 1), 0.0), ((0, 0), (1, 1), 0.0)],
)
def test_cosine(spark, a, b, expected):
    assert value(spark, vector.cosine(vec(*a), vec(*b))) == expected


def test_cosine_length_mismatch_is_an_error(spark):
    with pytest.raises(Exception, match="differ in length"):
        value(spark, vector.cosine(vec(1, 2), vec(1, 2, 3)))


@pytest.mark.parametrize(
    "query, start, end",
    [
        ("先月の出来事", "2026-01-01", "2026-02-01"),
        ("2025年6月の思い出", "2025-06-01", "2025-07-01"),
        ("先週の月曜日に何があった？", "2026-02-09", "2026-02-10"),
        ("3日前", "2026-02-16", "2026-02-19"),
        ("２週間後の予定", "2026-03-05", "2026-03-12"),
        ("昨日と今日", "2026-02-18", "2026-02-19"),
        ("一昨日", "2026-02-17", "2026-02-18"),
        ("明後日", "2026-02-21", "2026-02-22"),
        ("来年", "2027-01-01", "2028-01-01"),
        ("2024年の話", "2024-01-01", "2025-01-01"),
        ("2025年13月に去年", "2025-01-01", "2026-01-01"),
        ("99999999999日前", "2016-02-22", "2026-02-19"),
    ],
)
def test_time_range(spark, query, start, end):
    as_of = F.lit("2026-02-19 12:00:00").cast("timestamp")
    got = value(spark, timeparse.time_range(F.lit(query), as_of).cast("struct<a:string,b:string>"))
    assert (got.a[:10], got.b[:10]) == (start, end)


def test_no_time_range(spark):
    assert value(spark, timeparse.time_range(F.lit("こんにちは 1800年"), F.current_timestamp())) is None


def test_bigram_similarity_documented_example(spark):
    got = value(spark, text.bigram_similarity(F.lit("full text search"), F.lit("text similarity search")))
    assert round(got, 6) == round(4 / 7, 6)


@pytest.mark.parametrize(
    "query, keywords",
    [
        ("東京タワーについて教えてください", ["東京タワー", "教え"]),
        ("猫 犬", ["猫 犬"]),
        ("Alice Alice Bob", ["Alice", "Bob"]),
        ("a" * 1 + " " + "b" * 1 + " c d e f g h i j k l", []),
    ],
)
def test_keywords(spark, query, keywords):
    assert value(spark, text.extract_keywords(F.lit(query))) == keywords


@pytest.mark.parametrize("s, n", [("", 0), ("abcd", 1), ("あいう", 2), ("a", 1), ("😀a", 3)])
def test_estimate_tokens(spark, s, n):
    assert value(spark, text.estimate_tokens(F.lit(s))) == n


def test_format_ts(spark):
    assert value(spark, dates.format_ts(F.lit("2025-01-15T14:30:00Z"))) == "[2025/01/15 23:30]"
    assert value(spark, dates.format_ts(F.lit("never"))) == "[不明]"


@pytest.mark.parametrize(
    "answer, array",
    [
        ('[{"a": 1}]', '[{"a": 1}]'),
        ('Here: [1, [2, 3]] and [4]', "[1, [2, 3]]"),
        ("none", "[]"),
        ("[broken", "[]"),
    ],
)
def test_salvage(spark, answer, array):
    assert value(spark, text.salvage_json_array(F.lit(answer))) == array


MODES = [("any", ["a"], 3), ("any_strict", ["a"], 1), ("all", ["a", "b"], 3), ("all_strict", ["a", "b"], 1), ("odd", ["a"], 3)]


@pytest.mark.parametrize("mode, wanted, n", MODES)
def test_visibility(spark, mode, wanted, n):
    rows = spark.createDataFrame([(["a", "b"],), (["b", "c"],), ([],), (None,)], "tags array<string>")
    assert rows.filter(tags.visible(F.col("tags"), F.array(*map(F.lit, wanted)), mode)).count() == n


@pytest.mark.parametrize("axes, n", [((3, 3, 3), 0), ((5, 5, 5), 3), ((1, 3, 9), 2), ((None, "x", 2), 1)])
def test_guidance(spark, axes, n):
    columns = [F.lit(a).cast("string") for a in axes]
    assert len(value(spark, guidance.guidance_lines(*columns))) == n
    assert (value(spark, guidance.guidance_section(*columns)) == "") == (n == 0)


def ts(s):
    return dt.datetime.fromisoformat(s)


@pytest.mark.parametrize(
    "recent, older, span_days, expected",
    [
        (0, 5, 100, "stale"),
        (None, None, None, "stale"),
        (3, 0, 10, "new"),
        (30, 10, 60, "strengthening"),
        (15, 10, 60, "stable"),  # ratio exactly 1.5
        (5, 10, 60, "stable"),  # ratio exactly 0.5
        (4, 10, 60, "weakening"),
    ],
)
def test_freshness_status(spark, recent, older, span_days, expected):
    as_of = F.lit("2026-03-01").cast("timestamp")
    earliest = F.date_sub(as_of, span_days or 0).cast("timestamp")
    got = value(spark, freshness.status(F.lit(recent).cast("int"), F.lit(older).cast("int"), earliest, as_of))
    assert got == expected


def test_evidence_exactly_at_the_cutoff_is_older(spark):
    obs = spark.createDataFrame([(1, 9)], "bank_id bigint, unit_id bigint")
    units = spark.createDataFrame([(1, 1, ts("2026-01-30"))], "bank_id bigint, unit_id bigint, created_at timestamp")
    sources = spark.createDataFrame([(9, 1)], "obs_id bigint, source_id bigint")
    got = freshness.freshness(obs, sources, units, F.lit("2026-03-01").cast("timestamp")).collect()
    assert got[0].freshness_status == "stale"


def entity_case(spark, names, event_date=None, last_seen=None, company=()):
    mentions = spark.createDataFrame([(1, 1, n, event_date) for n in names], "call_id bigint, bank_id bigint, name string, event_date timestamp")
    known = spark.createDataFrame([(1, 7, "Alice", last_seen)], "bank_id bigint, entity_id bigint, canonical_name string, last_seen timestamp")
    met = spark.createDataFrame([(7, c) for c in company], "entity_id bigint, company string")
    rows = entities.resolve_entities(mentions, known, met).collect()
    scores = {r.name: r.score for r in entities.entity_scores(mentions, known, met).collect()}
    return {r.name: r.is_new for r in rows}, scores


def test_alias_alone_is_new(spark):
    resolved, scores = entity_case(spark, ["Alice Chen"])
    assert resolved == {"Alice Chen": True}


def test_alias_in_known_company_is_the_entity(spark):
    resolved, scores = entity_case(spark, ["Alice Chen", "bob"], company=["bob"])
    assert resolved["Alice Chen"] is False
    assert round(scores["Alice Chen"], 3) == 0.633


def test_exact_name_ignores_case_and_repeats(spark):
    resolved, scores = entity_case(spark, ["ALICE", "alice "])
    assert list(resolved.values()) == [False]
    assert scores["ALICE" if "ALICE" in scores else "alice"] == 1.0


def test_recent_entity_scores_higher(spark):
    day = ts("2026-02-19")
    near = entity_case(spark, ["Alicee"], day, ts("2026-02-18"))
    far = entity_case(spark, ["Alicee"], day, ts("2026-01-18"))
    none = entity_case(spark, ["Alicee"])
    assert near[0] == {"Alicee": False} and near[1]["Alicee"] > 0.6
    assert far == none == ({"Alicee": True}, {})


MESSAGES = "conv_id bigint, turn bigint, role string, content string"


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([("user", "part1"), ("user", "part2"), ("assistant", "x")], [("user", "part1\npart2"), ("assistant", "x"), ("user", "CONTINUE")]),
        ([("assistant", "x"), ("user", "y"), ("assistant", "z"), ("user", "q")], [("user", "y"), ("assistant", "z"), ("user", "q")]),
        ([("system", "x")], [("user", "CONTINUE")]),
    ],
)
def test_last_messages(spark, rows, expected):
    df = spark.createDataFrame([(1, i, r, c) for i, (r, c) in enumerate(rows)], MESSAGES)
    got = chatlog.last_messages(df).orderBy("pos").collect()
    assert [(r.role, r.content) for r in got] == expected


def test_normalize_needs_equal_ids_and_carries_images(spark):
    rows = [
        (1, 0, "user", None, "a", None),
        (1, 1, "user", None, "b", None),
        (1, 2, "user", "x", " c ", None),
        (1, 3, "user", "x", "d", "img"),
        (1, 4, "assistant", "x", "e", None),
        (1, 5, "assistant", "y", "", None),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, id string, content string, image string")
    got = chatlog.normalize(df).orderBy("turn").collect()
    assert [(r.turn, r.content, r.image) for r in got] == [(0, "a", None), (1, "b", None), (2, "c d", None), (4, "e", "img")]


def test_context_skips_a_line_that_does_not_fit(spark):
    rows = [(1, 1, "user", "old", "[t]", 1), (1, 2, "user", "x" * 2000, "[t]", 2), (1, 3, "assistant", "new", "[t]", 3)]
    df = spark.createDataFrame(rows, "query_id bigint, rank int, role string, content string, stamp string, turn bigint")
    got = chatlog.context_build(df, max_tokens=100).collect()[0].context
    assert got == chat.CONTEXT_HEADER + "[t] ユーザー: old\n[t] キャラクター: new"
    assert chatlog.context_build(df, max_tokens=5).collect()[0].context == ""


def test_utterances(spark):
    reply = "[Happy] こんにちは。元気ですか？```print(1)``` ... [sad] end"
    df = spark.createDataFrame([(1, reply)], "id bigint, text string")
    got = [(r.role, r.emotion, r.sentence, r.spoken) for r in chatlog.utterances(df).orderBy("segment", "pos").collect()]
    assert got[:3] == [
        ("assistant", "happy", "こんにちは。", True),
        ("assistant", "neutral", "元気ですか？", True),
        ("code", None, "print(1)", False),
    ]
    assert got[-1][2] == "[sad] end"
    assert any(not spoken for role, _, _, spoken in got if role == "assistant")


def test_continuity_transitions():
    state = streams.new_continuity()
    assert streams.continuity_step(state, False) == "process_messages" and state["no_comment_count"] == 1
    assert streams.continuity_step(state, True) == "send_comment" and state["no_comment_count"] == 0
    actions = [streams.continuity_step(state, False) for _ in range(8)]
    assert actions[5] == "sleep" and actions[6] == "do_nothing" and state["sleep_mode"]
    assert not streams.wants_judge(state, True)
    state = streams.new_continuity()
    assert streams.two_phase_tick(state, True, True, True) == "process_messages"
    assert state["continuation_count"] == 1 and state["no_comment_count"] == 1
    assert streams.two_phase_tick(state, True, True, True) == "send_comment"
    both = streams.new_continuity()
    assert streams.continuity_step(both, True, True) == "process_messages" and both["no_comment_count"] == 0
