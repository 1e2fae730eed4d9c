"""Operators cut into many small blocks give what the plain computation gives."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from anamnesis.functions import hooks
from anamnesis.operators import dedup, entities, links, live, order, reflect, search, similarity, temporal
from anamnesis.plans.retain import retain
from anamnesis.streaming import live as streams


def vectors(n, dim, seed, clusters=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = centres[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, dim))
    return rows


def frame(spark, rows, bank=None):
    data = [(i, 0 if bank is None else bank(i), [float(x) for x in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "unit_id bigint, bank_id bigint, embedding array<double>")


def cosines(rows):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return np.round(unit @ unit.T, 9)


@pytest.mark.parametrize("threshold", [0.1, 0.7, 0.9])
def test_pairs_in_many_blocks(spark, threshold):
    rows = vectors(300, 16, 1)
    df = frame(spark, rows)
    got = similarity.above(
        df.withColumnRenamed("unit_id", "a"), df.withColumnRenamed("unit_id", "b"), threshold, ["bank_id"], "a", "b", True, 40
    )
    found = {(r.a, r.b) for r in got.collect()}
    sims = cosines(rows)
    want = {(i, j) for i in range(300) for j in range(300) if i != j and sims[i, j] >= threshold}
    assert found == want


def test_nearest_in_many_blocks(spark):
    rows = vectors(200, 8, 2)
    df = frame(spark, rows, bank=lambda i: i % 2)
    got = similarity.nearest(df.withColumnRenamed("unit_id", "query_id"), df, 0.7, 5, rows_per_block=16, exclude_self=True)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rn, r.unit_id))
    sims = cosines(rows)
    for i in range(200):
        best = sorted((-sims[i, j], j) for j in range(200) if j != i and j % 2 == i % 2 and sims[i, j] >= 0.7)[:5]
        assert [u for _, u in sorted(found.get(i, []))] == [j for _, j in best]


def test_unequal_lengths_are_an_error(spark):
    df = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [1.0, 2.0])], "unit_id bigint, bank_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="differ in length"):
        similarity.nearest(df.withColumnRenamed("unit_id", "query_id"), df, 0.1, 5).collect()


def test_blocked_windows_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice("ab"), rng.randint(0, 5)) for k in range(3) for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k bigint, i bigint, c string, x bigint")
    block = F.floor(F.col("i") / 7).cast("bigint")
    plain = Window.partitionBy("k").orderBy("i")
    with_prev = order.with_previous(df, ["k"], ["i"], block, ["c"])
    starts = F.coalesce(F.col("prev.c") != F.col("c"), F.lit(True))
    got = order.with_run(with_prev, ["k"], ["i"], block, starts)
    got = order.with_running_sum(got, ["k"], ["i"], block, F.col("x"), "total")
    want = (
        df.withColumn("p", F.lag("c").over(plain))
        .withColumn("s", F.coalesce(F.col("p") != F.col("c"), F.lit(True)))
        .withColumn("r", F.max(F.when(F.col("s"), F.col("i"))).over(plain))
        .withColumn("t", F.sum("x").over(plain.rowsBetween(Window.unboundedPreceding, 0)))
    )
    left = {(r.k, r.i, r.prev.c if r.prev else None, r.run.i, r.total) for r in got.collect()}
    assert left == {(r.k, r.i, r.p, r.r, r.t) for r in want.collect()}


def test_chain_keeps_first_and_third(spark):
    # a~b and b~c but not a~c
    angle = np.arccos(0.92)
    rows = [[np.cos(k * angle), np.sin(k * angle)] for k in range(3)]
    df = frame(spark, np.array(rows)).withColumns({"event_date": F.lit("2026-01-01 03:00:00").cast("timestamp"), "fact_kind": F.lit("event")})
    assert sorted(r.unit_id for r in dedup.keep_new(df).collect()) == [0, 2]


def keep_model(rows, kinds, buckets, threshold):
    sims, kept = cosines(rows), []
    for i in range(len(rows)):
        pool = [j for j in kept if (buckets[j] == buckets[i] if buckets[i] is not None else kinds[j] == "conversation")]
        if not any(sims[i, j] >= threshold for j in pool):
            kept.append(i)
    return kept


@pytest.mark.parametrize("seed", [4, 5])
def test_dedup_equals_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    rows = vectors(150, 6, seed, clusters=12)
    for i in range(60, 150, 3):
        rows[i] = rows[rng.randrange(0, i)]
    kinds = [rng.choice(["event", "conversation"]) for _ in rows]
    buckets = [rng.choice([None, 0, 1]) for _ in rows]
    data = [
        (i, 0, [float(x) for x in r], kinds[i], None if buckets[i] is None else f"2026-01-0{1 + buckets[i]} 0{i % 9}:00:00")
        for i, r in enumerate(rows)
    ]
    df = spark.createDataFrame(data, "unit_id bigint, bank_id bigint, embedding array<double>, fact_kind string, d string")
    df = df.withColumn("event_date", F.col("d").cast("timestamp")).drop("d")
    got = sorted(r.unit_id for r in dedup.keep_new(df, threshold=0.95).collect())
    assert got == keep_model(rows, kinds, buckets, 0.95)


def test_close_names_miss_no_good_match(spark):
    rng = random.Random(6)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    known = sorted({n[: rng.randint(1, 9)] + rng.choice(["", "a", "bd"]) for n in names})
    at = dt.datetime(2026, 1, 5)
    mentions = spark.createDataFrame([(i, 0, n, at) for i, n in enumerate(names)], "call_id bigint, bank_id bigint, name string, event_date timestamp")
    seen = dt.datetime(2026, 1, 8, 6)
    stored = spark.createDataFrame([(0, i, n, seen) for i, n in enumerate(known)], "bank_id bigint, entity_id bigint, canonical_name string, last_seen timestamp")
    none = spark.createDataFrame([], "entity_id bigint, company string")
    got = {(r.name, r.canonical_name) for r in entities.entity_scores(mentions, stored, none).collect()}
    from difflib import SequenceMatcher

    want = {(a, b) for a in names for b in known if SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert want <= got


def test_ranges_equal_brute_force(spark):
    rng = random.Random(7)
    day = 86400

    def stamp(low=0, high=60):
        return rng.randint(low * day, high * day) if rng.random() < 0.6 else None

    units = []
    for i in range(120):
        start = stamp()
        units.append((i, i % 2, start, None if start is None or rng.random() < 0.3 else start + rng.randint(0, 40 * day), stamp(), stamp()))
    asks = [(q, q % 2, a := rng.randint(0, 60 * day), a + rng.randint(0, 9 * day)) for q in range(40)]
    cols = ["occurred_start", "occurred_end", "mentioned_at", "event_date"]
    u = spark.createDataFrame(units, "unit_id bigint, bank_id bigint, " + ", ".join(f"{c} bigint" for c in cols))
    q = spark.createDataFrame(asks, "query_id bigint, bank_id bigint, range_start bigint, range_end bigint")
    u = u.withColumns({c: F.timestamp_seconds(c) for c in cols})
    q = q.withColumns({c: F.timestamp_seconds(c) for c in ("range_start", "range_end")})
    got = sorted((r.query_id, r.unit_id) for r in temporal.units_in_range(q, u).select("query_id", "unit_id").collect())
    want = []
    for qid, qb, a, b in asks:
        for uid, ub, s, e, m, d in units:
            touches = any(x is not None and a <= x <= b for x in (s, e, m, d)) or (s is not None and e is not None and s <= b and e >= a)
            if qb == ub and touches:
                want.append((qid, uid))
    assert got == sorted(want)


def presence_model(frames, wait, leave, rest):
    state, out = live.new_presence(), []
    for us, face in frames:
        ended = live.presence_step(state, us, face, wait, leave, rest)
        out += [ended] if ended else []
    return out + [x[1:] for x in live.close_presence((0,), state, leave)]


def test_presence_in_pieces(spark):
    rng = random.Random(8)
    frames, at = [], 0
    for _ in range(600):
        at += rng.choice([1, 1, 1, 2, 9, 40])
        frames.append((at * 1_000_000, rng.random() < 0.8))
    df = spark.createDataFrame([(0, i, u, f) for i, (u, f) in enumerate(frames)], "device_id bigint, seq bigint, us bigint, face_detected boolean")
    df = df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    got = sorted((r.detected_us, r.departed_us) for r in live.presence(df, 2, 5, 8).collect())
    assert got == sorted(presence_model(frames, 2_000_000, 5_000_000, 8_000_000))


def test_continuity_closed_form_equals_the_machine(spark):
    rng = random.Random(9)
    ticks = sorted(rng.sample(range(200), 30))
    df = spark.createDataFrame([(0, t) for t in ticks], "channel_id bigint, tick bigint")
    got = {r.tick: (r.no_comment_count, r.action, r.sleep_mode) for r in live.continuity(df).collect()}
    state = streams.new_continuity()
    for tick in range(ticks[0], ticks[-1] + 1):
        action = streams.continuity_step(state, tick in ticks)
        assert got[tick] == (state["no_comment_count"], action, state["sleep_mode"])


@pytest.mark.parametrize("rows_per_block", [1, 1024])
def test_keyword_search_is_exact(spark, rows_per_block):
    texts = ["red apple pie", "green apple", "blue sky", "pie in the sky"]
    units = spark.createDataFrame([(0, i, t, None, "world") for i, t in enumerate(texts)], "bank_id bigint, unit_id bigint, text string, context string, fact_type string")
    asked = spark.createDataFrame([(1, 0, "apple"), (2, 0, "sky pie"), (3, 1, "apple")], "query_id bigint, bank_id bigint, text string")
    got = {(r.query_id, r.unit_id) for r in search.keyword_search(asked, units, rows_per_block=rows_per_block).collect()}
    assert got == {(1, 0), (1, 1), (2, 0), (2, 2), (2, 3)}


def test_long_texts_are_embedded_whole(spark):
    df = spark.createDataFrame([(1, "a " * 50 + "tail"), (2, "a " * 50)], "id bigint, text string")
    rows = {r.id: r.embedding for r in hooks.with_embeddings(df, "text", limit=10).collect()}
    assert rows[1] != rows[2]


def test_failing_model_leaves_null(spark):
    def broken(texts):
        raise RuntimeError("down")

    df = spark.createDataFrame([(1, "x")], "id bigint, text string")
    assert hooks.with_embeddings(df, "text", broken).collect()[0].embedding is None


def test_retain_counts(spark):
    contents = spark.createDataFrame(
        [(1, 0, "I like tea.\nTea is good.\nI like tea.", ""), (2, 0, "I like tea.", "ctx"), (3, 1, "I like tea.", None)],
        "call_id bigint, bank_id bigint, text string, context string",
    )
    done = retain(contents, F.lit("2026-01-01").cast("timestamp"))
    assert {(r.bank_id, r.stored, r.duplicates) for r in done.counts.collect()} == {(0, 2, 2), (1, 1, 0)}


@pytest.mark.parametrize(("threshold", "per"), [(-1.0, None), (0.1, "kind"), (0.95, None)])
def test_nearest_ranks_exactly_whatever_share_is_close(spark, threshold, per):
    # few values: many ties and copies
    rows = np.random.default_rng(5).integers(-1, 2, size=(400, 5)).astype(float)
    df = frame(spark, rows).withColumn("kind", F.col("unit_id") % 3)
    got = similarity.nearest(df.withColumnRenamed("unit_id", "query_id"), df, threshold, 4, per=per, exclude_self=True, rows_per_block=150)
    found = {}
    for r in got.collect():
        found.setdefault((r.query_id, r.unit_id % 3 if per else 0), []).append((r.rn, r.unit_id))
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
    sims = np.round(unit @ unit.T, 9)
    for i in range(400):
        for kind in range(3 if per else 1):
            best = sorted((-sims[i, j], j) for j in range(400) if j != i and sims[i, j] >= threshold and (not per or j % 3 == kind))[:4]
            assert [u for _, u in sorted(found.get((i, kind), []))] == [j for _, j in best]


def test_nearest_ranks_few_of_many_scores():
    scores = np.random.default_rng(6).normal(size=(50, 2_000)).astype(np.float32)
    scores[3, :5] = np.nan
    row, col = similarity._close(scores, np.float32(-9.0), 30, 0.0)
    assert len(row) == 50 * 30
    for i in range(50):
        assert set(col[row == i]) == set(np.argsort(-np.nan_to_num(scores[i], nan=-99.0))[:30])


def test_expanded_texts_are_not_sorted_by_request(spark):
    rng = random.Random(7)
    units = spark.createDataFrame([(b, 10 * b + i, "world", "ab" * rng.randint(0, 4_000)) for b in (0, 1) for i in range(10)], "bank_id bigint, unit_id bigint, fact_type string, text string")
    units = units.unionByName(units.filter("unit_id = 3"))
    asked = {(q, q % 2, rng.randint(0, 19), rng.randint(0, 12)) for q in range(60) for _ in range(15)}
    requests = spark.createDataFrame([*asked], "query_id bigint, bank_id bigint, unit_id bigint, pos bigint")
    pieces = reflect.chunks(units, 100)
    rows = reflect.expand_units(requests, units, pieces)
    got = sorted((r.query_id, r.unit_id, -1 if r.chunk_index is None else r.chunk_index, r.text or "") for r in rows.collect())
    kept = requests.filter("pos < 10")
    order = Window.partitionBy("query_id").orderBy("unit_id", "chunk_index")
    shown = kept.join(pieces, ["bank_id", "unit_id"]).withColumn("n", F.row_number().over(order)).filter("n <= 100")
    plain = kept.join(units.select("bank_id", "unit_id"), ["bank_id", "unit_id"]).select("query_id", "unit_id").join(shown, ["query_id", "unit_id"], "left")
    assert got == sorted((r.query_id, r.unit_id, -1 if r.chunk_index is None else r.chunk_index, r.text or "") for r in plain.collect())
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [at for at, line in enumerate(plan) if "Window" in line and "query_id" in line]
    assert windows and not any("text#" in plan[at + 1] for at in windows)


def test_links_of_rare_and_frequent_entities(spark):
    rng = random.Random(8)
    units = [(u % 2, u // 6 if u % 17 else None, u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 99))) for u in range(300)]
    bridge = {(u, rng.choice([1, 1, 2, *range(3, 20)]) * 2 + (u % 2 if rng.random() < 0.9 else 0)) for u in range(300) for _ in range(2)}
    df = spark.createDataFrame(units, "bank_id bigint, batch_id bigint, unit_id bigint, created_at timestamp")
    found = links.entity_links(df, spark.createDataFrame([*bridge], "unit_id bigint, entity_id bigint"))
    got = [(r.bank_id, r.from_unit_id, r.to_unit_id, r.entity_id) for r in found.collect()]
    want = set()
    for entity in {e for _, e in bridge}:
        mine = [units[u] for u, e in bridge if e == entity]
        for bank, call, unit, _ in mine:
            others = [x for x in mine if x[2] != unit]
            own = [x for x in others if (x[0], x[1]) == (bank, call) and call is not None]
            rest = [x for x in others if x not in own and (x[0] != bank or None not in (x[1], call))]
            rest = sorted(rest, key=lambda x: (x[3], x[2]), reverse=True)[:50]
            want |= {edge for x in own + rest for edge in ((bank, unit, x[2], entity), (bank, x[2], unit, entity))}
    assert len(got) == len(set(got))
    assert set(got) == want
    few = links.entity_links(df, spark.createDataFrame([(u, 2 + u % 2) for u in range(40)], "unit_id bigint, entity_id bigint"))
    assert few.count() == 2 * 20 * 19 - sum(1 for a in range(40) for b in range(40) if a != b and a % 2 == b % 2 and None in (units[a][1], units[b][1]))


def test_blocks_of_a_large_key_copy_few_rows(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("bank_id"), F.col("id").alias("_uid"))
    limit = similarity.ROWS_PER_BLOCK
    left, right, _ = similarity.block_grid(rows, rows.withColumnRenamed("_uid", "_qid"), ["bank_id"], "_uid", "_qid", limit, limit)
    assert left.count() + right.count() < 600_000
    left, right, blocks = similarity.block_grid(
        rows, rows.withColumnRenamed("_uid", "_qid"), ["bank_id"], "_uid", "_qid", limit, limit, similarity.QUERY_BLOCKS
    )
    assert left.count() + right.count() < 600_000
    assert right.select(*blocks).distinct().count() == similarity.QUERY_BLOCKS


def test_candidates_keep_the_best_and_few_others():
    rng = np.random.default_rng(7)
    stored, asked = (rng.normal(size=(n, 16)).astype(np.float32) for n in (20_000, 64))
    stored[100:140] = stored[0]
    stored[7] = np.nan
    scores = np.nan_to_num(asked @ stored.T, nan=-np.inf)
    for least in (-100.0, 2.0):
        row, col = similarity._candidates(asked, stored, np.float32(least), 5, 1e-4)
        assert len(row) < 64 * 60
        found = set(zip(row.tolist(), col.tolist()))
        for i in range(64):
            assert {(i, j) for j in np.argsort(-scores[i])[:5].tolist() if scores[i, j] >= least} <= found
    row, col = similarity._candidates(asked, stored, np.float32(2.0), None, 1e-4)
    assert len(row) == np.count_nonzero(scores >= 2.0)


def test_trigrams_of_names_are_not_broadcast(spark, tmp_path):
    """Spark takes the size of the names for that of their trigrams, which are many times as much."""
    from anamnesis.operators.summaries import has_model

    known = [(0, 1, "Maria Santos"), (0, 2, "maria  santos"), (0, 3, "Paul Weber"), (1, 4, "Paul Sebastian Weber"), (0, 5, None)]
    spark.createDataFrame(known, "bank_id long, entity_id long, canonical_name string").write.parquet(f"{tmp_path}/known")
    named = [(0, 9, "Maria Santos"), (1, 8, "Paul Sebastian Webern"), (0, 3, "Other")]
    spark.createDataFrame(named, "bank_id long, entity_id long, name string").write.parquet(f"{tmp_path}/named")
    found = has_model(spark.read.parquet(f"{tmp_path}/known"), spark.read.parquet(f"{tmp_path}/named"))
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "gram#" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]
    # 20 of 23 trigrams of the last two names are shared
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1), (0, 2), (0, 3), (1, 4)]


def test_pairs_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    """More pairs, more tasks: the memory of one stays the same, whatever number of partitions the session has."""
    monkeypatch.setattr(entities, "ROWS_PER_TASK", 10, raising=False)
    rows = [(0, u // 2, u, u, e) for u in range(20) for e in range(u % 3, 5)]
    named = spark.createDataFrame(rows, "bank_id long, batch_id long, at long, unit_id long, entity_id long")
    counts = entities.cooccurrence(named)
    # 7 units have 5 entities, 7 have 4 and 6 have 3: 130 pairs
    assert counts.rdd.getNumPartitions() == 13
    merged = entities.merge_cooccurrence(counts, counts, 15)
    assert merged.rdd.getNumPartitions() == 15
    want = {}
    for _, call, at, unit, e in rows:
        for _, _, _, other, f in rows:
            if unit == other and e < f:
                want.setdefault((e, f), {})[call] = max(at, want.get((e, f), {}).get(call, 0))
    got = {(r.entity_id_1, r.entity_id_2): (r.cooccurrence_count, r.last_cooccurred) for r in merged.collect()}
    assert got == {pair: (2 * len(calls), max(calls.values())) for pair, calls in want.items()}
