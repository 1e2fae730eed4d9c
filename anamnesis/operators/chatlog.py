"""Chat logs: merge, window, diff, transcripts, context and utterances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.functions import chat
from anamnesis.functions.text import strip
from anamnesis.operators.order import top, turn_block, with_previous, with_run

# Fixed values of the log rules.
LAST_MESSAGES = 10
CONTINUE = "CONTINUE"
CONTEXT_TOKENS = 1000


def text_messages(messages: DataFrame) -> DataFrame:
    return messages.filter(F.length("content") > 0)


def audio_messages(messages: DataFrame) -> DataFrame:
    """System rows with content, user rows with text, assistant rows with audio."""
    role = F.col("role")
    return messages.filter(
        ((role == "system") & (F.length("content") > 0))
        | ((role == "user") & F.col("content").isNotNull())
        | ((role == "assistant") & F.col("audio").isNotNull())
    )


def _joined(parts: str | Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["content"]), separator)


def normalize(messages: DataFrame) -> DataFrame:
    """Consecutive rows of one role and one id become one row, joined by a blank.

    Rows without id never merge; rows left empty drop out.  With an ``image``
    column a row gets its own image, or the one a merged-away row before it
    brought along.
    """
    keys, order = ["conv_id"], ["turn"]
    before = with_previous(messages, keys, order, turn_block("turn"), ["role", "id"])
    same = (F.col("prev.role") == F.col("role")) & (F.col("prev.id") == F.col("id"))
    starts = ~F.coalesce(same, F.lit(False))
    runs = with_run(before, keys, order, turn_block("turn"), starts).drop("prev")
    first = F.col("turn") == F.col("run.turn")
    content = F.coalesce("content", F.lit(""))
    parts = F.struct("turn", F.when(first, strip(content)).otherwise(content).alias("content"))
    aggregates = [
        F.first("role").alias("role"),
        F.first("id").alias("id"),
        F.collect_list(parts).alias("_parts"),
    ]
    if "image" in messages.columns:
        aggregates += [
            F.max(F.when(first, F.col("image"))).alias("_own"),
            F.max_by("image", F.when(~first & F.col("image").isNotNull(), F.col("turn"))).alias("_brought"),
        ]
    merged = runs.groupBy("conv_id", F.col("run.turn").alias("turn")).agg(*aggregates)
    merged = merged.withColumn("content", _joined("_parts", " ")).drop("_parts")
    if "image" in messages.columns:
        merged = with_previous(merged, keys, order, turn_block("turn"), ["_brought"])
        merged = merged.withColumn("image", F.coalesce("_own", "prev._brought")).drop("_own", "_brought", "prev")
        return merged.filter((F.col("content") != "") | F.col("image").isNotNull())
    return merged.filter(F.col("content") != "")


def last_messages(messages: DataFrame, n: int = LAST_MESSAGES) -> DataFrame:
    """(conv_id, pos, role, content): the dialogue window a model gets.

    The last n user and assistant rows, neighbours of one role merged by a
    newline, starting with a user row and ending with one (CONTINUE if needed).
    """
    dialogue = messages.filter(F.col("role").isin("user", "assistant"))
    recent = top(dialogue, ["conv_id"], [F.desc("turn")], n)
    # from here on at most n rows a conversation
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    changed = F.coalesce(F.lag("role").over(by_turn) != F.col("role"), F.lit(True)).cast("int")
    runs = recent.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(by_turn))
    merged = runs.groupBy("conv_id", "_run").agg(
        F.first("role").alias("role"),
        F.collect_list(F.struct("turn", F.coalesce("content", F.lit("")).alias("content"))).alias("_parts"),
    )
    merged = merged.withColumn("content", _joined("_parts", "\n")).drop("_parts")
    kept = merged.filter((F.col("_run") > 1) | (F.col("role") == "user"))
    last = kept.groupBy("conv_id").agg(F.max_by("role", "_run").alias("last"), F.max("_run").alias("_run"))
    closing = (
        messages.select("conv_id")
        .distinct()
        .join(last, "conv_id", "left")
        .filter(F.coalesce(F.col("last") == "assistant", F.lit(True)))
        .select(
            "conv_id",
            (F.coalesce("_run", F.lit(0)) + 1).alias("_run"),
            F.lit("user").alias("role"),
            F.lit(CONTINUE).alias("content"),
        )
    )
    both = kept.select("conv_id", "_run", "role", "content").unionByName(closing)
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("_run"))
    return both.withColumn("pos", pos).drop("_run")


def processed_messages(messages: DataFrame, n: int = LAST_MESSAGES, with_timestamp: bool = True) -> DataFrame:
    """The last n rows ready for a prompt; only the very last keeps its image."""
    stamp = F.col("timestamp") if with_timestamp else F.lit(None).cast("string")
    recent = top(messages, ["conv_id"], [F.desc("turn")], n)
    return recent.select(
        "conv_id",
        "turn",
        chat.prompt_role(F.col("role")).alias("role"),
        chat.prompt_text(F.col("role"), F.coalesce("content", F.lit("")), F.col("user_name"), stamp).alias("content"),
        F.when(F.col("rn") == 1, F.col("image")).alias("image"),
    )


def latest_assistant(messages: DataFrame) -> DataFrame:
    """(conv_id, content) of the last assistant row; '' when there is none."""
    return messages.groupBy("conv_id").agg(
        F.coalesce(F.max_by("content", F.when(F.col("role") == "assistant", F.col("turn"))), F.lit("")).alias("content")
    )


def memory_records(messages: DataFrame) -> DataFrame:
    """User and assistant rows with text, as they enter the memory."""
    return messages.filter(F.col("role").isin("user", "assistant") & (F.length("content") > 0))


def upsert(stored: DataFrame, changes: DataFrame, keys: Sequence[str], order: str, required: Sequence[str]) -> DataFrame:
    """Fold changes into stored rows: given fields override, missing ones stay.

    An unknown key starts with the first change that has every required field;
    what came before it is lost.
    """
    fields = [c for c in stored.columns if c not in keys]
    complete = F.lit(True)
    for field in required:
        complete = complete & F.col(field).isNotNull()
    base = stored.select(*keys, *fields, F.lit(None).cast("bigint").alias("_at"), F.lit(True).alias("_known"))
    new = changes.select(*keys, *fields, F.col(order).cast("bigint").alias("_at"), F.lit(False).alias("_known"))
    every = base.unionByName(new).withColumn("_at", F.coalesce("_at", F.lit(-(2**62))))
    born = every.groupBy(*keys).agg(F.min(F.when(F.col("_known") | complete, F.col("_at"))).alias("_born"))
    live = every.join(born, list(keys)).filter(F.col("_at") >= F.col("_born"))
    latest = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_at"))).alias(f) for f in fields]
    return live.groupBy(*keys).agg(*latest)


def diff(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that are new or whose content changed."""
    old = previous.select(*keys, F.col("content").alias("_old"), F.lit(True).alias("_seen"))
    rows = current.join(old, list(keys), "left")
    return rows.filter(F.col("_seen").isNull() | ~F.col("content").eqNullSafe(F.col("_old"))).drop("_old", "_seen")


def transcript(messages: DataFrame, n: int = LAST_MESSAGES) -> DataFrame:
    """(conv_id, transcript): "role: content" lines of the last n rows."""
    recent = top(messages, ["conv_id"], [F.desc("turn")], n)
    line = F.struct("turn", F.concat("role", F.lit(": "), "content").alias("content"))
    return recent.groupBy("conv_id").agg(_joined(F.collect_list(line), "\n").alias("transcript"))


def context_build(records: DataFrame, max_tokens: int = CONTEXT_TOKENS, detailed: bool = True) -> DataFrame:
    """(query_id, context): the found memories as one text within a token limit.

    ``records(query_id, rank, role, content, stamp, turn)`` are the memories a search found, as many as it returned.
    """
    stamp = F.col("stamp") if detailed else None
    line = chat.context_line(F.col("role"), F.col("content"), stamp)
    found = records.select("query_id", "turn", line.alias("content"))
    lines = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("turn", "content"))).alias("_lines"))
    return lines.select("query_id", chat.packed_context(F.col("_lines.content"), max_tokens).alias("context"))


def utterances(texts: DataFrame) -> DataFrame:
    """(…, segment, pos, role, emotion, sentence, spoken): what a reply says, piece by piece.

    Fenced code is one piece of role 'code'; everything else is cut into
    sentences with their emotion tags, symbols alone are not spoken.
    """
    keys = [c for c in texts.columns if c != "text"]
    segments = texts.select(*keys, F.posexplode(chat.fenced_segments(F.col("text"))).alias("segment", "s"))
    pieces = F.when(F.col("s.code"), F.array("s.body")).otherwise(chat.spoken_pieces(F.col("s.body")))
    rows = segments.select(*keys, "segment", F.col("s.code").alias("code"), F.posexplode(pieces).alias("pos", "piece"))
    sentence = F.when(F.col("code"), F.col("piece")).otherwise(chat.piece_sentence(F.col("piece")))
    return rows.select(
        *keys,
        "segment",
        "pos",
        F.when(F.col("code"), "code").otherwise("assistant").alias("role"),
        F.when(~F.col("code"), chat.piece_emotion(F.col("piece"))).alias("emotion"),
        sentence.alias("sentence"),
        (~F.col("code") & chat.speakable(sentence)).alias("spoken"),
    )


def comment_match(answers: DataFrame, comments: DataFrame) -> DataFrame:
    """(tick keys, comment_id): the comment a model's answer names.

    Quotes around the answer are ignored; an equal comment wins, then one that
    contains or is contained in it, then the first of the tick.
    """
    keys = ["channel_id", "tick"]
    bare = strip(F.regexp_replace(F.regexp_replace("answer", "^[\"'「『（(]+", ""), "[\"'」』）)]+$", ""))
    said = answers.select(*keys, bare.alias("_said"))
    quality = (
        F.when(F.col("comment") == F.col("_said"), 0)
        .when(F.col("_said").contains(F.col("comment")) | F.col("comment").contains(F.col("_said")), 1)
        .otherwise(2)
    )
    ranked = comments.join(said, keys).withColumn("_quality", quality)
    return top(ranked, keys, [F.asc("_quality"), F.asc("comment_id")], 1).select(*keys, "comment_id", "comment")


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, role, text): start/…/end chunks put together to messages.

    A message grows while the role stays and no start or end lies in between;
    output, executing and console chunks count as code, user chunks are ignored.
    """
    role = F.when(F.col("role").isin("output", "executing", "console"), "code").otherwise(F.col("role"))
    rows = chunks.withColumn("role", role).filter(F.col("role") != "user")
    block = turn_block("seq")
    before = with_previous(rows, ["stream_id"], ["seq"], block, ["role", "type"])
    grows = (F.col("prev.role") == F.col("role")) & ~F.coalesce(F.col("prev.type").isin("start", "end"), F.lit(False))
    starts = ~F.coalesce(grows, F.lit(False)) | (F.coalesce(F.col("type"), F.lit("")) == "start")
    runs = with_run(before, ["stream_id"], ["seq"], block, starts).drop("prev")
    body = runs.filter(F.coalesce(F.col("type"), F.lit("")) != "start")
    part = F.struct(F.col("seq").alias("turn"), F.col("text").alias("content"))
    return (
        body.groupBy("stream_id", F.col("run.seq").alias("seq"))
        .agg(F.first("role").alias("role"), F.collect_list(part).alias("_parts"))
        .withColumn("text", _joined("_parts", ""))
        .drop("_parts")
    )


THINKING_MARKER = "\x00THINK:"


def split_stream(chunks: DataFrame) -> DataFrame:
    """(message_id, content, thinking): chunks with the marker are thinking, the rest is content."""
    marked = F.col("text").startswith(THINKING_MARKER)
    body = F.when(marked, F.substring("text", len(THINKING_MARKER) + 1, 2**31 - 1)).otherwise(F.col("text"))
    part = F.struct(F.col("seq").alias("turn"), body.alias("content"))
    return chunks.groupBy("message_id").agg(
        _joined(F.collect_list(F.when(~marked, part)), "").alias("content"),
        _joined(F.collect_list(F.when(marked, part)), "").alias("thinking"),
    )
