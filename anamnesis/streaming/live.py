"""Live operators on streams.

The reference rules know no event time; the watermark delays here are
parameters, and rows later than the delay are dropped.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.operators import live
from anamnesis.streaming.fold import keyed_fold


def dedup_comments(comments: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each comment id once; comments without id all pass."""
    marked = comments.withWatermark("ts", delay)
    # a row without id stands for itself
    ident = F.coalesce(F.col("comment_id").cast("string"), F.concat(F.lit("row-"), F.expr("uuid()")))
    return marked.withColumn("_ident", ident).dropDuplicatesWithinWatermark(["_ident"]).drop("_ident")


def tick_counts(comments: DataFrame, seconds: int, delay: str = "1 minute") -> DataFrame:
    """(channel_id, window, comments) once a tick is complete."""
    clean = live.clean_comments(comments).withWatermark("ts", delay)
    return clean.groupBy("channel_id", F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("comments"))


# --- conversation continuity


def new_continuity() -> dict:
    return {"no_comment_count": 0, "continuation_count": 0, "sleep_mode": False, "tick": None}


def wants_judge(state: dict, has_assistant: bool) -> bool:
    """Whether the model is asked at all in this state."""
    return not state["sleep_mode"] and state["continuation_count"] < 1 and has_assistant


def continuity_step(
    state: dict,
    has_comments: bool,
    go_on: bool = False,
    new_topic: int = live.NEW_TOPIC_AFTER,
    sleep: int = live.SLEEP_AFTER,
) -> str:
    """Advance one channel by one tick and return its action.

    ``go_on`` is the judge's verdict.  It takes precedence over comments, but
    the empty-tick count still restarts when there are any.
    """
    if has_comments:
        count = 0
    elif go_on:
        count = max(state["no_comment_count"], 1)
    else:
        count = state["no_comment_count"] + 1
    if go_on:
        state.update(no_comment_count=count, continuation_count=state["continuation_count"] + 1, sleep_mode=False)
        return "process_messages"
    if has_comments:
        state.update(no_comment_count=0, continuation_count=0, sleep_mode=False)
        return "send_comment"
    asleep = state["sleep_mode"] if count > sleep else count == sleep and count != new_topic
    state.update(no_comment_count=count, continuation_count=0, sleep_mode=asleep)
    if count > sleep:
        return "do_nothing"
    return "sleep" if asleep else "process_messages"


def two_phase_tick(state: dict, has_comments: bool, has_assistant: bool, go_on: bool) -> str:
    """One tick with the judge asked first, before any comment is fetched."""
    if wants_judge(state, has_assistant) and go_on:
        return continuity_step(state, False, True)
    state["continuation_count"] = 0
    return continuity_step(state, has_comments, False)


def continuity(comments: DataFrame) -> DataFrame:
    """(channel_id, tick, no_comment_count, action, sleep_mode), emitted as ticks pass.

    ``comments(channel_id, tick)``: a tick's first comment also settles the
    empty ticks before it.
    """

    def step(state: dict, row: Any) -> list[tuple]:
        tick = int(row.tick)
        if state["tick"] is not None and tick <= state["tick"]:
            return []
        out = []
        for empty in range((tick if state["tick"] is None else state["tick"] + 1), tick):
            action = continuity_step(state, False)
            out.append((empty, state["no_comment_count"], action, state["sleep_mode"]))
        out.append((tick, 0, continuity_step(state, True), False))
        state["tick"] = tick
        return out

    schema = "channel_id bigint, tick bigint, no_comment_count bigint, action string, sleep_mode boolean"
    return keyed_fold(comments, "channel_id", ["tick"], step, new_continuity, schema)


# --- client queues


def client_queue(operations: DataFrame, timeout: int = live.CLIENT_TIMEOUT_SECONDS) -> DataFrame:
    """(client_id, seq, delivered_seq): every message a read drains.

    A client idle for longer than the timeout loses its messages.  The batch
    form also wants some client's post to fall into that time; with any
    traffic at all both agree.
    """

    def step(state: dict, row: Any) -> list[tuple]:
        us = int(row.us)
        if state["us"] is not None and us - state["us"] > timeout * 1_000_000:
            state["waiting"] = []
        state["us"] = us
        if row.op == "post":
            state["waiting"].append(int(row.seq))
            return []
        drained, state["waiting"] = state["waiting"], []
        return [(seq, int(row.seq)) for seq in drained]

    rows = operations.select("client_id", "seq", F.unix_micros("ts").alias("us"), "op")
    schema = "client_id bigint, seq bigint, delivered_seq bigint"
    return keyed_fold(rows, "client_id", ["us", "seq"], step, lambda: {"us": None, "waiting": []}, schema)


# --- presence


def presence(detections: DataFrame, threshold: float, departure: float, cooldown: float) -> DataFrame:
    """(device_id, detected_us, departed_us) of every presence that has ended."""
    wait, leave, rest = (int(s * 1_000_000) for s in (threshold, departure, cooldown))

    def step(state: dict, row: Any) -> list[tuple]:
        ended = live.presence_step(state, int(row.us), bool(row.face_detected), wait, leave, rest)
        return [ended] if ended else []

    rows = detections.select("device_id", F.unix_micros("ts").alias("us"), "seq", "face_detected")
    schema = "device_id bigint, detected_us bigint, departed_us bigint"
    return keyed_fold(rows, "device_id", ["us", "seq"], step, live.new_presence, schema)


# --- chunk streams


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, role, text): a message is emitted when the next one starts or it ends."""

    def step(state: dict, row: Any) -> list[tuple]:
        role = "code" if row.role in ("output", "executing", "console") else row.role
        if role == "user":
            return []
        kind = row.type if isinstance(row.type, str) else ""
        out = []
        if state["parts"] and (kind == "start" or state["role"] != role):
            out, state["parts"] = [(state["seq"], state["role"], "".join(state["parts"]))], []
        if kind == "start":
            return out
        if not state["parts"]:
            state.update(seq=int(row.seq), role=role)
        state["parts"].append(row.text)
        if kind == "end":
            out.append((state["seq"], state["role"], "".join(state["parts"])))
            state["parts"] = []
        return out

    schema = "stream_id bigint, seq bigint, role string, text string"
    return keyed_fold(chunks, "stream_id", ["seq"], step, lambda: {"seq": None, "role": None, "parts": []}, schema)




def silence_segments(speech: DataFrame, timeout_seconds: int, delay: str = "10 seconds") -> DataFrame:
    """(device_id, session_window, pieces) of utterances closed by silence."""
    marked = speech.withWatermark("ts", delay)
    return marked.groupBy("device_id", F.session_window("ts", f"{timeout_seconds} seconds")).agg(
        F.count("*").alias("pieces")
    )
