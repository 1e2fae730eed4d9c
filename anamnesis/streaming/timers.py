"""Streams with timers: what happens because nothing happens.

Rows of a key wait in its state until the watermark has passed them, so they
are taken in the order of their event time however they arrive, as long as
they come within the delay.  Between them, and after the last one, a key's
timer fires at its event time, also if no further row of that key ever comes:
the rows of other keys move the clock.  A key that is back where it started
leaves the state store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from anamnesis.operators import live
from anamnesis.streaming.live import continuity_step, new_continuity

# waiting rows of a key that are Python objects at once
ROWS_PER_STEP = 8_192
# texts of an utterance that are joined as soon as there are so many
TEXTS_PER_PART = 1_024


class Machine(NamedTuple):
    """``step(state, row)`` takes a row, ``due(state)`` names the next timer in microseconds (None: none), and
    ``expire(state, us)`` lets it run out; both give rows without the key.  States hold what JSON can hold."""

    start: Callable[[], dict]
    step: Callable[[dict, dict], list[tuple]]
    due: Callable[[dict], int | None]
    expire: Callable[[dict, int], list[tuple]]


def advance(machine: Machine, state: dict, rows: list[dict], now: int) -> list[tuple]:
    """Take ``rows`` (sorted, none later than ``now``) and every timer up to ``now``, in the order of their times."""
    out = []

    def run_out(until: int) -> None:
        while (due := machine.due(state)) is not None and due <= until:
            out.extend(machine.expire(state, due))

    for row in rows:
        run_out(row["us"])
        out.extend(machine.step(state, row))
    run_out(now)
    return out


def timed_fold(stream: DataFrame, key: str, order: list[str], machine: Machine, schema: str, delay: str) -> DataFrame:
    """Rows that ``machine`` gives for every key; ``stream`` has ``ts``, the key, and what the machine reads.

    Rows that wait are held as Arrow columns; only ROWS_PER_STEP of them at a time become Python objects.
    """
    columns = [part.strip().split()[0] for part in schema.split(",")]
    rows = stream.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    kind = to_arrow_schema(rows.drop("ts", key).schema, prefers_large_types=True)

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, packed = state.get if state.exists else (None, None)
        at = machine.start() if held is None else json.loads(held)
        parts = [kind.empty_table()] if packed is None else [_unpacked(packed)]
        if not state.hasTimedOut:
            parts += [pa.Table.from_pandas(batch[kind.names], kind, preserve_index=False) for batch in batches]
        now = state.getCurrentWatermarkMs() * 1000
        waiting = pa.concat_tables(parts).sort_by([(c, "ascending") for c in order])
        del parts, packed
        if waiting["us"].null_count:
            raise ValueError("a row has no time")
        n = pc.sum(pc.less_equal(waiting["us"], now)).as_py() or 0
        for begin in range(0, n, ROWS_PER_STEP):
            ready = waiting.slice(begin, min(ROWS_PER_STEP, n - begin)).to_pylist()
            found = advance(machine, at, ready, ready[-1]["us"])
            yield pd.DataFrame([(group[0], *out) for out in found], columns=columns)
        found = advance(machine, at, [], now)
        yield pd.DataFrame([(group[0], *out) for out in found], columns=columns)
        later = waiting.slice(n)
        due = machine.due(at)
        first = later["us"][0].as_py() if len(later) else None
        wake = min([us for us in (first, due) if us is not None], default=None)
        if not len(later) and at == machine.start():
            state.remove()
        else:
            state.update((json.dumps(at), _packed(later) if len(later) else None))
            if wake is not None:
                # a timer fires as soon as the watermark is beyond its time
                state.setTimeoutTimestamp(max(-(-wake // 1000) - 1, now // 1000))

    return rows.groupBy(key).applyInPandasWithState(
        fold, schema, "state string, waiting binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(packed)) as reader:
        return reader.read_all()


# --- a channel without comments falls asleep


def idle_machine(seconds: int) -> Machine:
    """One action per tick from a comment on, until the channel sleeps."""
    length = seconds * 1_000_000

    def step(state: dict, row: dict) -> list[tuple]:
        tick = row["us"] // length
        if state["tick"] == tick and state["no_comment_count"] == 0:
            return []
        state["tick"] = tick
        return [(tick, 0, continuity_step(state, True), False)]

    def expire(state: dict, us: int) -> list[tuple]:
        tick, action = state["tick"] + 1, continuity_step(state, False)
        out = [(tick, state["no_comment_count"], action, state["sleep_mode"])]
        state.update(new_continuity() if state["sleep_mode"] else {"tick": tick})
        return out

    # the tick after the last settled one is empty when it ends
    return Machine(new_continuity, step, lambda state: None if state["tick"] is None else (state["tick"] + 2) * length, expire)


def idle_sleep(comments: DataFrame, seconds: int, delay: str) -> DataFrame:
    """(channel_id, tick, no_comment_count, action, sleep_mode) of every tick from a comment to the tick that puts the channel to sleep.

    ``comments(channel_id, ts)``.  Ticks of a sleeping channel do nothing and aren't told.
    """
    schema = "channel_id bigint, tick bigint, no_comment_count bigint, action string, sleep_mode boolean"
    return timed_fold(comments.select("channel_id", "ts"), "channel_id", ["us"], idle_machine(seconds), schema, delay)


# --- an idle client is dropped


def client_machine(timeout: int) -> Machine:
    def step(state: dict, row: dict) -> list[tuple]:
        state["us"] = row["us"]
        state["waiting"] = 0 if row["op"] == "read" else state["waiting"] + 1
        return []

    def expire(state: dict, us: int) -> list[tuple]:
        out = [(state["waiting"], us - 1)] if state["waiting"] else []
        state.update(us=None, waiting=0)
        return out

    # idle for longer than the timeout
    due = lambda state: None if state["us"] is None else state["us"] + timeout * 1_000_000 + 1
    return Machine(lambda: {"us": None, "waiting": 0}, step, due, expire)


def idle_clients(operations: DataFrame, delay: str, timeout: int = live.CLIENT_TIMEOUT_SECONDS) -> DataFrame:
    """(client_id, messages, dropped_us): clients that lose waiting messages because they were idle too long.

    ``operations(client_id, seq, ts, op)`` are posts and reads.
    """
    rows = operations.select("client_id", "ts", "seq", "op")
    return timed_fold(rows, "client_id", ["us", "seq"], client_machine(timeout), "client_id bigint, messages bigint, dropped_us bigint", delay)


# --- an absent person has departed


def presence_machine(threshold: float, departure: float, cooldown: float) -> Machine:
    wait, leave, rest = (int(s * 1_000_000) for s in (threshold, departure, cooldown))

    def step(state: dict, row: dict) -> list[tuple]:
        ended = live.presence_step(state, row["us"], row["face_detected"], wait, leave, rest)
        return [ended] if ended else []

    def due(state: dict) -> int | None:
        if state["detected"] is not None:
            return None if state["lost"] is None else state["lost"] + leave
        return state["rest_until"] if state["since"] is None else None

    def expire(state: dict, us: int) -> list[tuple]:
        if state["detected"] is None:
            # the cooldown is over, and nobody is there
            state.update(live.new_presence())
            return []
        ended = (state["detected"], us)
        state.update(live.new_presence() | {"rest_until": us + rest})
        return [ended]

    return Machine(live.new_presence, step, due, expire)


def departures(detections: DataFrame, threshold: float, departure: float, cooldown: float, delay: str) -> DataFrame:
    """(device_id, detected_us, departed_us) of every presence, told when the departure time is over."""
    rows = detections.select("device_id", "ts", "seq", "face_detected")
    machine = presence_machine(threshold, departure, cooldown)
    return timed_fold(rows, "device_id", ["us", "seq"], machine, "device_id bigint, detected_us bigint, departed_us bigint", delay)


# --- silence closes an utterance


def silence_machine(timeout_seconds: float) -> Machine:
    def start() -> dict:
        return {"start": None, "end": None, "pieces": 0, "parts": [], "texts": []}

    def step(state: dict, row: dict) -> list[tuple]:
        if state["start"] is None:
            state["start"] = row["us"]
        state["end"] = row["us"]
        state["pieces"] += 1
        state["texts"].append(row["text"] or "")
        if len(state["texts"]) == TEXTS_PER_PART:
            state["parts"].append(" ".join(state["texts"]))
            state["texts"] = []
        return []

    def expire(state: dict, us: int) -> list[tuple]:
        text = " ".join(state["parts"] + state["texts"])
        out = [(state["start"], state["end"], state["pieces"], text)] if text.strip() else []
        state.update(start())
        return out

    due = lambda state: None if state["end"] is None else state["end"] + int(timeout_seconds * 1_000_000)
    return Machine(start, step, due, expire)


def closed_utterances(speech: DataFrame, timeout_seconds: float, delay: str) -> DataFrame:
    """(device_id, start_us, end_us, pieces, transcript) of utterances, told when the silence after them is long enough."""
    schema = "device_id bigint, start_us bigint, end_us bigint, pieces bigint, transcript string"
    return timed_fold(speech.select("device_id", "ts", "seq", "text"), "device_id", ["us", "seq"], silence_machine(timeout_seconds), schema, delay)
