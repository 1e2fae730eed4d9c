"""Live comments, queues, presence and idle rules over finite tables.

These are the batch forms of the operators in anamnesis.streaming; on the same
input both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.operators.order import time_block, top, turn_block, with_previous, with_run, with_running_sum

# Fixed values of the live rules.
NEW_TOPIC_AFTER, SLEEP_AFTER = 3, 6
CLIENT_TIMEOUT_SECONDS = 300
IDLE_MIN_SECONDS, IDLE_MAX_SECONDS, IDLE_DEFAULT_SECONDS = 10, 300, 30


def clean_comments(comments: DataFrame) -> DataFrame:
    """Drop empty comments and those that start with '#'."""
    return comments.filter((F.length("comment") > 0) & ~F.col("comment").startswith("#"))


def dedup_comments(comments: DataFrame) -> DataFrame:
    """First comment of every id; comments without id all pass."""
    identified = comments.filter(F.col("comment_id").isNotNull())
    others = [c for c in comments.columns if c not in ("comment_id", "ts")]
    first = F.min(F.struct("ts", *others)).alias("_first")
    kept = identified.groupBy("comment_id").agg(first).select("comment_id", "_first.*")
    return kept.select(*comments.columns).unionByName(comments.filter(F.col("comment_id").isNull()))


def tick_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds).cast("bigint")


def ticked(comments: DataFrame, seconds: int) -> DataFrame:
    """Comments with the number of the tick that drains them."""
    return comments.withColumn("tick", tick_of(F.col("ts"), seconds))


def sample_comment(comments: DataFrame, seed: str) -> DataFrame:
    """One comment per channel and tick, picked by a hash of its id."""
    pick = F.struct(F.md5(F.concat(F.lit(seed), F.col("comment_id").cast("string"))), F.col("comment_id"))
    return comments.groupBy("channel_id", "tick").agg(
        F.max_by("comment_id", pick).alias("comment_id"), F.max_by("comment", pick).alias("comment")
    )


def continuity(comments: DataFrame, new_topic: int = NEW_TOPIC_AFTER, sleep: int = SLEEP_AFTER) -> DataFrame:
    """(channel_id, tick, no_comment_count, action, sleep_mode) of every tick between comments.

    The state without a judge depends only on how many empty ticks lie behind,
    so it is computed from the distance to the last tick with comments.
    """
    busy = comments.select("channel_id", "tick").distinct()
    gaps = with_previous(busy, ["channel_id"], ["tick"], turn_block("tick"), ["tick"])
    since = F.coalesce(F.col("prev.tick"), F.col("tick") - 1)
    rows = gaps.select("channel_id", F.col("tick").alias("_busy"), since.alias("_since"))
    rows = rows.withColumn("tick", F.explode(F.sequence(F.col("_since") + 1, F.col("_busy"))))
    answered = F.col("tick") == F.col("_busy")
    count = F.when(answered, F.lit(0)).otherwise(F.col("tick") - F.col("_since"))
    action = (
        F.when(answered, "send_comment")
        .when(F.col("no_comment_count") > sleep, "do_nothing")
        .when(F.col("no_comment_count") == new_topic, "process_messages")
        .when(F.col("no_comment_count") == sleep, "sleep")
        .otherwise("process_messages")
    )
    return (
        rows.withColumn("no_comment_count", count.cast("bigint"))
        .withColumn("action", action)
        .withColumn("sleep_mode", F.col("no_comment_count") >= sleep)
        .select("channel_id", "tick", "no_comment_count", "action", "sleep_mode")
    )


def client_queue(operations: DataFrame, timeout: int = CLIENT_TIMEOUT_SECONDS) -> DataFrame:
    """(client_id, seq, delivered_seq): the read that drains each posted message, NULL if none.

    ``operations(client_id, seq, ts, op)`` are posts and reads in order of
    (ts, seq).  A post of any client removes the clients idle for longer than
    the timeout, their messages included.
    """
    limit = timeout * 1_000_000
    ops = operations.select("client_id", "seq", "ts", "op").withColumn("us", F.unix_micros("ts"))
    before = with_previous(ops, ["client_id"], ["us", "seq"], time_block("ts"), ["us", "op"])
    # posts of all clients up to the end of the idle allowance, and up to this operation
    posts = ops.filter(F.col("op") == "post").select(F.col("us").alias("at"), F.lit(0).alias("kind"), F.col("seq").alias("mark"))
    gaps = before.filter(F.col("us") - F.col("prev.us") > limit)
    lower = gaps.select((F.col("prev.us") + limit).alias("at"), F.lit(1).alias("kind"), F.col("seq").alias("mark"))
    upper = gaps.select(F.col("us").alias("at"), F.lit(2).alias("kind"), F.col("seq").alias("mark"))
    marks = posts.unionByName(lower).unionByName(upper).withColumn("scope", F.lit(0))
    marks = marks.withColumn("ts", F.timestamp_micros("at"))
    counted = with_running_sum(
        marks, ["scope"], ["at", "kind", "mark"], time_block("ts", 60), F.when(F.col("kind") == 0, 1).otherwise(0), "posts"
    )
    removed = (
        counted.filter("kind > 0")
        .groupBy(F.col("mark").alias("seq"))
        .agg((F.max("posts") > F.min("posts")).alias("removed"))
    )
    rows = before.join(removed, "seq", "left")
    starts = F.col("prev").isNull() | (F.col("prev.op") == "read") | F.coalesce("removed", F.lit(False))
    runs = with_run(rows, ["client_id"], ["us", "seq"], time_block("ts"), starts)
    reads = runs.filter(F.col("op") == "read").select("client_id", "run", F.col("seq").alias("delivered_seq"))
    return (
        runs.filter(F.col("op") == "post")
        .join(reads, ["client_id", "run"], "left")
        .select("client_id", "seq", "delivered_seq")
    )


def idle_gaps(activity: DataFrame, interval: int = IDLE_DEFAULT_SECONDS) -> DataFrame:
    """(channel_id, since_us, n, fire_us): every idle firing between two log changes."""
    seconds = max(IDLE_MIN_SECONDS, min(IDLE_MAX_SECONDS, interval))
    rows = activity.withColumn("us", F.unix_micros("ts")).select("channel_id", "ts", "us", "seq")
    gaps = with_previous(rows, ["channel_id"], ["us", "seq"], time_block("ts"), ["us"])
    step = seconds * 1_000_000
    firings = F.floor((F.col("us") - F.col("prev.us")) / step).cast("bigint")
    return (
        gaps.filter(firings > 0)
        .select("channel_id", F.col("prev.us").alias("since_us"), F.explode(F.sequence(F.lit(1), firings)).alias("n"))
        .withColumn("fire_us", F.col("since_us") + F.col("n") * step)
    )


def rotate_phrases(firings: DataFrame, phrases: list[str]) -> DataFrame:
    """Firings with the phrase whose turn it is, in the given order."""
    rows = firings.withColumn("ts", F.timestamp_micros("fire_us"))
    placed = with_running_sum(rows, ["channel_id"], ["fire_us"], time_block("ts"), F.lit(1), "place")
    slot = F.pmod(F.col("place") - 1, F.lit(len(phrases))).cast("int")
    listed = F.array(*[F.lit(p) for p in phrases])
    return placed.withColumn("phrase", F.get(listed, slot)).drop("ts", "place")


def silence_segments(speech: DataFrame, timeout_seconds: float) -> DataFrame:
    """(device_id, start_us, end_us, pieces, transcript): utterances closed by silence >= timeout."""
    rows = speech.withColumn("us", F.unix_micros("ts"))
    order, block = ["us", "seq"], time_block("ts")
    before = with_previous(rows, ["device_id"], order, block, ["us"])
    silent = F.col("us") - F.col("prev.us") >= int(timeout_seconds * 1_000_000)
    runs = with_run(before.withColumn("_new", F.coalesce(silent, F.lit(True))).drop("prev"), ["device_id"], order, block, F.col("_new"))
    part = F.struct("us", "seq", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), " ")
    return (
        runs.groupBy("device_id", "run")
        .agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("pieces"), joined.alias("transcript"))
        .drop("run")
        .filter(F.col("transcript").rlike(r"\S"))
    )


def presence(detections: DataFrame, threshold: float, departure: float, cooldown: float) -> DataFrame:
    """(device_id, detected_us, departed_us): when a person was there.

    A face seen without a break for ``threshold`` seconds, outside the
    cooldown, counts as a person; a face lost for ``departure`` seconds as a
    departure, after which ``cooldown`` seconds pass.  After a loss of
    departure + cooldown seconds nothing before it matters, so each device is
    cut there and the pieces are folded independently, a batch at a time.
    """
    rows = detections.withColumn("us", F.unix_micros("ts")).select("device_id", "ts", "us", "seq", "face_detected")
    order, block = ["us", "seq"], time_block("ts")
    before = with_previous(rows, ["device_id"], order, block, ["face_detected"])
    changed = F.coalesce(F.col("prev.face_detected") != F.col("face_detected"), F.lit(True))
    islands = with_run(before.withColumn("_new", changed).drop("prev"), ["device_id"], order, block, F.col("_new"), "island")
    heads = islands.filter("_new").select("device_id", "ts", "us", "seq", "face_detected")
    fresh = with_previous(heads, ["device_id"], order, block, ["us"])
    quiet = F.col("us") - F.col("prev.us") >= int((departure + cooldown) * 1_000_000)
    cut = F.col("prev").isNull() | (F.col("face_detected") & F.coalesce(quiet, F.lit(False)))
    pieces = with_run(fresh.withColumn("_cut", cut).drop("prev"), ["device_id"], order, block, F.col("_cut"), "piece")
    known = pieces.select("device_id", F.struct("us", "seq").alias("island"), F.col("piece.us").alias("piece_us"), F.col("piece.seq").alias("piece_seq"))
    frames = islands.join(known, ["device_id", "island"]).select("device_id", "piece_us", "piece_seq", "us", "seq", "face_detected")
    ordered = frames.repartition("device_id", "piece_us", "piece_seq").sortWithinPartitions(
        "device_id", "piece_us", "piece_seq", "us", "seq"
    )
    wait, leave, rest = (int(s * 1_000_000) for s in (threshold, departure, cooldown))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, state = None, None
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                if (row.device_id, row.piece_us, row.piece_seq) != piece:
                    found += close_presence(piece, state, leave)
                    piece, state = (row.device_id, row.piece_us, row.piece_seq), new_presence()
                ended = presence_step(state, int(row.us), bool(row.face_detected), wait, leave, rest)
                if ended:
                    found.append((row.device_id, *ended))
            yield pd.DataFrame(found, columns=["device_id", "detected_us", "departed_us"]).astype({"departed_us": "Int64"})
        yield pd.DataFrame(close_presence(piece, state, leave), columns=["device_id", "detected_us", "departed_us"]).astype({"departed_us": "Int64"})

    return ordered.mapInPandas(fold, "device_id bigint, detected_us bigint, departed_us bigint")


def new_presence() -> dict:
    return {"since": None, "detected": None, "lost": None, "rest_until": None}


def presence_step(state: dict, us: int, face: bool, wait: int, leave: int, rest: int) -> tuple[int, int] | None:
    """Advance one device by one frame; returns (detected, departed) when a presence ended."""
    ended = None
    if state["detected"] is not None and state["lost"] is not None and us >= state["lost"] + leave:
        departed = state["lost"] + leave
        ended = (state["detected"], departed)
        state.update(detected=None, lost=None, since=None, rest_until=departed + rest)
    if not face:
        if state["since"] is not None:
            state["since"] = None
            if state["detected"] is not None and state["lost"] is None:
                state["lost"] = us
        return ended
    state["lost"] = None
    if state["since"] is None:
        state["since"] = us
    resting = state["rest_until"] is not None and us < state["rest_until"]
    if state["detected"] is None and not resting and us - state["since"] >= wait:
        state["detected"] = us
    return ended


def close_presence(piece, state: dict | None, leave: int) -> list[tuple]:
    """What is open when a device's frames end: the timer still runs out."""
    if state is None or state["detected"] is None:
        return []
    return [(piece[0], state["detected"], None if state["lost"] is None else state["lost"] + leave)]
