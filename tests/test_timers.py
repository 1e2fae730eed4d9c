"""Timers fire without a further row of their key, and late or shuffled rows change nothing."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import live
from anamnesis.streaming import timers
from anamnesis.streaming.fold import run_to_end

SECOND = 1_000_000


def stream(spark, path, batches, schema):
    """A stream that reads one file of ``batches`` after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us")).drop("us").coalesce(1).write.parquet(f"{path}/in/{i:03d}")
    kind = spark.read.parquet(f"{path}/in/000").schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def shuffled(rows, seed, seconds):
    """The rows in an order of arrival at most ``seconds`` late, in four files."""
    draw = random.Random(seed)
    arrived = sorted(rows, key=lambda r: r[1] + draw.random() * seconds * SECOND)
    cut = -(-len(arrived) // 4)
    return [arrived[i : i + cut] for i in range(0, len(arrived), cut)]


def test_idle_channel_sleeps(spark, tmp_path):
    """Channel 1 speaks once; channel 2 goes on and moves the clock."""
    batches = [[(1, 5 * SECOND), (2, 6 * SECOND)], [(2, 47 * SECOND)], [(2, 95 * SECOND)]]
    rows = timers.idle_sleep(stream(spark, tmp_path, batches, "channel_id long, us long"), 10, "0 seconds")
    found = run_to_end(rows, str(tmp_path)).collect()
    mine = sorted((r.tick, r.no_comment_count, r.action, r.sleep_mode) for r in found if r.channel_id == 1)
    assert mine == [(0, 0, "send_comment", False)] + [(n, n, "process_messages", False) for n in range(1, 6)] + [(6, 6, "sleep", True)]
    other = sorted((r.tick, r.no_comment_count) for r in found if r.channel_id == 2)
    assert other == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 0), (5, 1), (6, 2), (7, 3), (8, 4), (9, 0)]


def test_idle_client_is_dropped(spark, tmp_path):
    batches = [[(1, SECOND, 1, "post"), (1, 2 * SECOND, 2, "post"), (2, SECOND, 3, "post")], [(2, 11 * SECOND, 4, "read")], [(3, 40 * SECOND, 5, "post")]]
    rows = timers.idle_clients(stream(spark, tmp_path, batches, "client_id long, us long, seq long, op string"), "0 seconds", 10)
    found = [tuple(r) for r in run_to_end(rows, str(tmp_path)).collect()]
    # the read comes exactly at the end of client 2's time and still drains it
    assert found == [(1, 2, 12 * SECOND)]


@pytest.mark.parametrize("seed", [1, 2])
def test_departures_equal_the_batch_form(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows, at = [], 0
    for i in range(600):
        at += draw.choice([1, 1, 2, 5, 30]) * SECOND
        rows.append((draw.randrange(3), at, i, draw.random() < 0.7))
    schema = "device_id long, us long, seq long, face_detected boolean"
    told = timers.departures(stream(spark, tmp_path, shuffled(rows, seed, 60), schema), 2, 5, 9, "90 seconds")
    # a last row moves the clock past the delay
    got = {tuple(r) for r in run_to_end(told, str(tmp_path)).collect()}
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us"))
    clock = at - 90 * SECOND
    want = {tuple(r) for r in live.presence(batch, 2, 5, 9).collect() if r.departed_us is not None and r.departed_us <= clock}
    assert got == want and len(got) > 5


def test_silence_closes_an_utterance(spark, tmp_path):
    rows = [(1, SECOND, 1, "good"), (1, 4 * SECOND, 2, "day"), (1, 20 * SECOND, 3, " "), (2, 50 * SECOND, 4, "late")]
    told = timers.closed_utterances(stream(spark, tmp_path, [rows[:2][::-1], rows[2:]], "device_id long, us long, seq long, text string"), 10, "5 seconds")
    assert [tuple(r) for r in run_to_end(told, str(tmp_path)).collect()] == [(1, SECOND, 4 * SECOND, 2, "good day")]


def test_a_key_leaves_its_state():
    """Every machine comes back to its start once its time is over."""
    cases = [
        (timers.idle_machine(10), {}),
        (timers.client_machine(10), {"op": "post"}),
        (timers.presence_machine(0, 5, 5), {"face_detected": True}),
        (timers.silence_machine(10), {"text": "a"}),
    ]
    for machine, row in cases:
        state = machine.start()
        rows = [row | {"us": 0}, row | {"us": SECOND}]
        if "face_detected" in row:
            rows.append({"us": 2 * SECOND, "face_detected": False})
        timers.advance(machine, state, rows, 1_000 * SECOND)
        assert state == machine.start() and machine.due(state) is None


def test_waiting_rows_are_no_python_objects(spark, tmp_path):
    """The rows of a key all wait for the first watermark; they are held as columns, so a key's size hardly counts."""
    n = 150_000

    def step(state, row):
        state["n"] += 1
        return [(state["n"], sys.getallocatedblocks())] if state["n"] in (1, n) else []

    machine = timers.Machine(lambda: {"n": 0}, step, lambda state: None, lambda state, us: [])
    rows = spark.range(n + 1).selectExpr("if(id = 0, 0, 1) as key", "timestamp_micros(1000000 + id) as ts", "id as seq", "concat('text ', id) as text")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/000")
    spark.range(1).selectExpr("2 as key", "timestamp_micros(60000000) as ts", "id as seq", "'' as text").write.parquet(f"{tmp_path}/in/001")
    stream = spark.readStream.schema("key int, ts timestamp, seq long, text string").option("recursiveFileLookup", "true")
    held = timers.timed_fold(stream.parquet(f"{tmp_path}/in"), "key", ["us", "seq"], machine, "key int, n long, blocks long", "0 seconds")
    blocks = {(r.key, r.n): r.blocks for r in run_to_end(held, str(tmp_path)).collect()}
    assert (1, n) in blocks and blocks[1, 1] - blocks[0, 1] < n
