"""Pipelines and streaming jobs on small stored tables."""

import json

from pyspark.sql import functions as F

from anamnesis.operators import consolidate, links
from anamnesis.plans.consolidation import consolidate_all
from anamnesis.plans.retain import link, retain
from anamnesis.sources import chatlog, tables
from anamnesis.streaming import jobs
from anamnesis.streaming import live as streams
from anamnesis.streaming.fold import run_to_end

CONTENTS = "call_id bigint, bank_id bigint, text string, context string"


def as_of():
    return F.lit("2026-01-01").cast("timestamp")


def units_for_consolidation(spark):
    unit = {0: [1.0, 0.0], 1: [0.98, 0.2], 2: [0.0, 1.0], 3: [0.1, 0.99]}
    rows = [(1, i, f"fact {i}", "world", v, f"2026-01-0{i + 1} 00:00:00") for i, v in unit.items()]
    df = spark.createDataFrame(rows, "bank_id bigint, unit_id bigint, text string, fact_type string, embedding array<double>, created string")
    none = F.lit(None).cast("timestamp")
    return df.select(
        "*",
        F.col("created").cast("timestamp").alias("created_at"),
        F.lit(1).cast("bigint").alias("proof_count"),
        *[none.alias(c) for c in ("event_date", "occurred_start", "occurred_end", "mentioned_at", "consolidated_at")],
    ).drop("created")


def test_consolidate_all(spark):
    sources = spark.createDataFrame([], "obs_id bigint, source_id bigint")
    done = consolidate_all(units_for_consolidation(spark), sources, as_of(), per_bank=1)
    observations = {r.text: r.proof_count for r in done.units.filter("fact_type = 'observation'").collect()}
    assert observations == {"fact 1": 2, "fact 3": 2}
    assert done.units.filter("fact_type = 'world' and consolidated_at is null").count() == 0
    assert {(r.source_id) for r in done.sources.collect()} == {0, 1, 2, 3}


def test_update_counts_a_repeated_source_once(spark):
    facts = units_for_consolidation(spark).filter("unit_id < 2")
    observations = units_for_consolidation(spark).filter("unit_id = 2").withColumn("fact_type", F.lit("observation"))
    sources = spark.createDataFrame([(2, 0)], "obs_id bigint, source_id bigint")
    actions = spark.createDataFrame(
        [(0, "update", "new", 2), (1, "update", "newer", 2), (1, "update", "x", 99)],
        "fact_id bigint, action string, text string, learning_id bigint",
    )
    got = consolidate.updated_observations(observations, sources, actions, facts).collect()
    assert [(r.unit_id, r.text, r.proof_count) for r in got] == [(2, "newer", 2)]


def test_retain_resolves_and_links(spark):
    def extractor(text, context):
        return [
            {"text": line, "who": ["Ann", "ann "], "fact_kind": "event", "event_date": "2026-01-01T05:00:00Z"}
            for line in text.split("|")
        ]

    contents = spark.createDataFrame([(1, 0, "tea time|tea time|rain falls", "")], CONTENTS)
    done = retain(contents, as_of(), extractor=extractor)
    assert done.counts.collect()[0].asDict() == {"bank_id": 0, "stored": 2, "duplicates": 1}
    assert done.unit_entities.count() == 2 and done.new_entities.count() == 1
    edges = link(done.units, done.unit_entities, done.units.limit(0), 0.99)
    assert {(r.link_type, r.links) for r in links.link_counts(edges).collect()} == {("temporal", 2), ("entity", 2)}
    assert {r.link_type for r in done.links.collect()} >= {"temporal", "entity"} and done.cooccurrences.count() == 0
    again = retain(
        spark.createDataFrame([(2, 0, "sun shines", "")], CONTENTS),
        as_of(),
        done.units,
        done.new_entities,
        extractor=extractor,
        stored_entities=done.unit_entities,
    )
    assert again.new_entities.count() == 0
    assert again.links.filter("link_type = 'entity'").count() == 4


def test_large_calls_lose_no_links(spark):
    """All pairs of a call within a day are linked, and other calls' partners are found beside any number of own ones."""
    none = F.lit(None).cast("timestamp")
    day = F.lit("2026-01-01 12:00:00").cast("timestamp")
    units = spark.range(120).select(
        F.lit(0).cast("bigint").alias("bank_id"),
        F.when(F.col("id") < 110, 1).otherwise(2).cast("bigint").alias("batch_id"),
        F.col("id").alias("unit_id"),
        day.alias("event_date"),
        none.alias("occurred_start"),
        none.alias("mentioned_at"),
        (day + F.expr("make_interval(0, 0, 0, 0, 0, id)")).alias("created_at"),
    )
    inside = links.temporal_links(units.filter("batch_id = 1"))
    assert inside.count() == 110 * 109
    bridge = units.select("unit_id", F.lit(5).cast("bigint").alias("entity_id"))
    linked = links.entity_links(units.filter("batch_id = 1"), bridge, units)
    assert linked.filter("from_unit_id < 110 and to_unit_id < 110").count() == 110 * 109
    assert linked.filter("from_unit_id < 110 and to_unit_id >= 110").count() == 110 * 10
    assert links.entity_links(units.filter("batch_id = 2"), bridge, units).filter("from_unit_id >= 110 and to_unit_id < 110").count() == 10 * 50


def test_two_observations_of_one_fact_and_a_failed_one(spark):
    def decide(facts, related):
        ids = facts.select(F.col("unit_id").alias("fact_id"), F.lit(None).cast("bigint").alias("learning_id"), F.lit("").alias("reason"))
        failed = F.col("fact_id") == 3
        twice = F.explode(F.when(failed, F.array(F.lit("x"))).otherwise(F.array(F.lit("one"), F.lit("two"))))
        rows = ids.withColumn("text", twice).withColumn("action", F.when(failed, "failed").otherwise("create"))
        return rows.select("fact_id", "action", "text", "learning_id", "reason")

    sources = spark.createDataFrame([], "obs_id bigint, source_id bigint")
    bridge = spark.createDataFrame([(0, 7)], "unit_id bigint, entity_id bigint")
    done = consolidate_all(units_for_consolidation(spark), sources, as_of(), decide, per_bank=2, unit_entities=bridge)
    made = done.units.filter("fact_type = 'observation'").collect()
    assert len({r.unit_id for r in made}) == 6 and {r.text for r in made} == {"one", "two"}
    assert {r.unit_id for r in done.units.filter("fact_type = 'world' and consolidated_at is null").collect()} == {3}
    assert done.entities.filter("entity_id = 7").count() == 2


def test_ten_newest_of_eleven(spark):
    rows = [(0, b, b, f"2026-01-01 0{b // 10}:{b % 10}0:00".replace("0:60", "1:00")) for b in range(6)]
    rows += [(0, 10 + b, 10 + b, f"2026-01-01 02:{b}0:00") for b in range(6)]
    df = spark.createDataFrame(rows, "bank_id bigint, batch_id bigint, unit_id bigint, at string")
    none = F.lit(None).cast("timestamp")
    df = df.select("bank_id", "batch_id", "unit_id", F.col("at").cast("timestamp").alias("event_date"), none.alias("occurred_start"), none.alias("mentioned_at"))
    edges = links.temporal_links(df.filter("unit_id = 15"), df.filter("unit_id <> 15"))
    partners = {r.to_unit_id for r in edges.filter("from_unit_id = 15").collect()}
    assert partners == {1, 2, 3, 4, 5, 10, 11, 12, 13, 14}


def test_retain_stream_stores_nothing_twice(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = spark.createDataFrame([(1, 0, "I like tea.\nIt rains.", "")], CONTENTS)
    first.write.json(source)
    stream = spark.readStream.schema(CONTENTS).json(source)
    jobs.retain_stream(stream, out, as_of(), once=True).awaitTermination()
    spark.createDataFrame([(2, 0, "I like tea.\nNew fact here.", "")], CONTENTS).write.mode("append").json(source)
    jobs.retain_stream(stream, out, as_of(), once=True).awaitTermination()
    stored = spark.read.parquet(f"{out}/units")
    assert sorted(r.text for r in stored.collect()) == ["I like tea.", "It rains.", "New fact here."]


def test_consolidate_stream_takes_each_fact_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    units = units_for_consolidation(spark).drop("consolidated_at")
    sources = spark.createDataFrame([], "obs_id bigint, source_id bigint")
    for _ in range(2):
        units.select("bank_id", "unit_id").write.mode("append").json(source)
        stream = spark.readStream.schema("bank_id bigint, unit_id bigint").json(source)
        jobs.consolidate_stream(stream, out, units, sources, as_of(), once=True).awaitTermination()
    taken = spark.read.parquet(f"{out}/actions")
    assert sorted(r.fact_id for r in taken.collect()) == [0, 1, 2, 3]


def test_killed_retain_equals_an_undisturbed_one(spark, tmp_path):
    first = [(1, 0, "Ann met Bob\nBob likes tea", "")]
    second = [(2, 0, "Ann met Cid again\nBob likes tea", ""), (3, 1, "Ann sleeps", "")]
    found = {}

    def extractor(text, context):
        return [{"text": line, "who": [w for w in line.split() if w.istitle()]} for line in text.split("\n")]

    for killed in (False, True):
        source, out = str(tmp_path / f"in{killed}"), str(tmp_path / f"out{killed}")
        for n, calls in enumerate((first, second)):
            spark.createDataFrame(calls, CONTENTS).coalesce(1).write.mode("append").json(source)
            stream = spark.readStream.schema(CONTENTS).json(source)
            if killed and n == 1:
                # tables of the second micro-batch without its commit, as a job leaves them that is killed in between
                rubbish = spark.read.parquet(f"{out}/units").drop("batch").withColumn("text", F.lit("half written"))
                rubbish.write.parquet(f"{out}/units/batch={n}")
                assert {r.text for r in jobs.retained(spark, out)["units"].collect()} == {"Ann met Bob", "Bob likes tea"}
            jobs.retain_stream(stream, out, as_of(), extractor=extractor, once=True).awaitTermination()
        tables = jobs.retained(spark, out)
        found[killed] = {name: sorted(map(str, df.drop("embedding").collect())) for name, df in tables.items()}
    assert found[True] == found[False]
    names = {(r.bank_id, r.canonical_name): r.mention_count for r in tables["entities"].collect()}
    assert names == {(0, "Ann"): 2, (0, "Bob"): names[(0, "Bob")], (0, "Cid"): 1, (1, "Ann"): 1}
    pairs = tables["cooccurrences"].collect()
    assert len(pairs) == 2 and len(found[True]["links"]) > 0


def test_consolidate_stream_applies_its_actions(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    units = units_for_consolidation(spark).withColumn("bank_id", F.col("unit_id") % 2)
    sources = spark.createDataFrame([], "obs_id bigint, source_id bigint")
    for bank in (0, 1, 0):
        spark.createDataFrame([(bank, bank)], "bank_id bigint, unit_id bigint").write.mode("append").json(source)
        stream = spark.readStream.schema("bank_id bigint, unit_id bigint").json(source)
        jobs.consolidate_stream(stream, out, units, sources, as_of(), per_bank=1, once=True).awaitTermination()
    after, cited = jobs.consolidated(spark, out, units, sources)
    whole = consolidate_all(units, sources, as_of(), per_bank=1)
    view = lambda df: sorted((r.bank_id, r.text, r.fact_type, r.proof_count, r.consolidated_at is None) for r in df.collect())
    assert view(after) == view(whole.units)
    assert after.select("unit_id").distinct().count() == after.count()
    assert sorted(r.source_id for r in cited.collect()) == sorted(r.source_id for r in whole.sources.collect())


def test_consolidate_stream_keeps_failed_facts_open(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    sources = spark.createDataFrame([], "obs_id bigint, source_id bigint")
    done_before = F.when(F.col("unit_id") == 0, as_of())
    units = units_for_consolidation(spark).withColumn("consolidated_at", done_before)
    fails = {"bad": [3]}

    def decide(facts, related):
        failed = F.col("unit_id").isin(fails["bad"])
        return facts.select(
            F.col("unit_id").alias("fact_id"),
            F.when(failed, "failed").otherwise("create").alias("action"),
            "text",
            F.lit(None).cast("bigint").alias("learning_id"),
            F.lit("").alias("reason"),
        )

    left = []
    for bad in ([3], [-1]):
        fails["bad"] = bad
        spark.createDataFrame([(1, 0)], "bank_id bigint, unit_id bigint").write.mode("append").json(source)
        stream = spark.readStream.schema("bank_id bigint, unit_id bigint").json(source)
        jobs.consolidate_stream(stream, out, units, sources, as_of(), decide, once=True).awaitTermination()
        after, _ = jobs.consolidated(spark, out, units, sources)
        left.append({r.unit_id for r in after.filter("fact_type = 'world' and consolidated_at is null").collect()})
    assert left == [{3}, set()]
    assert sorted(r.text for r in after.filter("fact_type = 'observation'").collect()) == ["fact 1", "fact 2", "fact 3"]


def test_log_arrays(spark, tmp_path):
    good = [{"role": "user", "content": "hi", "embedding": [0.5]}, {"role": "assistant", "content": [{"type": "text", "text": "yo"}]}]
    (tmp_path / "log_2026-01-02T03-04-05-678Z.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "log_2026-01-01T00-00-00-000Z.json").write_text("{broken")
    (tmp_path / "other.json").write_text(json.dumps(good))
    messages = chatlog.read_arrays(spark, str(tmp_path))
    rows = [r.asDict() for r in chatlog.catalogue(messages).collect()]
    assert rows == [
        {"file_name": "log_2026-01-02T03-04-05-678Z.json", "created_at": "2026-01-02T03:04:05", "message_count": 2, "has_embeddings": True}
    ]


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2)], "unit_id bigint, entity_id bigint")
    tables.store(rows, str(tmp_path), "unit_entities")
    assert tables.load(spark, str(tmp_path), "unit_entities").collect() == rows.collect()
    deleted = spark.createDataFrame([(5,)], "bank_id bigint")
    units = spark.createDataFrame([(5, 1), (6, 9)], "bank_id bigint, unit_id bigint")
    left = tables.delete_banks({"units": units, "unit_entities": rows}, deleted)
    assert left["unit_entities"].count() == 0 and left["units"].count() == 1


def test_stream_state_survives_a_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "channel_id bigint, tick bigint"
    for ticks in ([1, 2], [9]):
        spark.createDataFrame([(0, t) for t in ticks], schema).write.mode("append").json(source)
        found = run_to_end(streams.continuity(spark.readStream.schema(schema).json(source)), out)
    got = {r.tick: r.action for r in found.collect()}
    assert got[1] == got[2] == got[9] == "send_comment"
    assert got[8] == "sleep" and got[3] == "process_messages" and len(got) == 9
