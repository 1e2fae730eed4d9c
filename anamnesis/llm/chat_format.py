r"""Chat formatting with a grammar round trip.

A conversation becomes one text, turn after turn:

    ### role: text
    </turn>

``### `` and ``</turn>`` are control strings.  A text may hold them too, so
each turn is rendered, reparsed by the same deterministic parser that reads
whole conversations, and compared with its source; while it isn't identical,
the next, stronger escape is tried.  The escape puts one backslash before a
control string and the backslashes that stand before it; the parser takes one
off again, and everywhere else a backslash is a plain character.  As the
parser finds no bare control string inside a text that it accepts, the turns
of a conversation can't run into each other; the finished conversation is
reparsed once more all the same, and an error is raised if a turn differs.

Role names are percent-encoded, which leaves ordinary names as they are.

The loss mask has one entry per turn: start (code points, from 0) and length
of the turn's text in the formatted conversation; the length is 0 where the
role isn't trained on.

Defined cases: a null text or role counts as empty; a null conv_id is a
conversation of its own; rows that agree in turn are ordered by role and text,
a null turn comes first; repeated rows are turns of their own; an empty table
has no conversations; other columns play no part.  A conversation is one
string of the output, so its size is bounded by that of a string; rows are
rendered before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN = "### "
END_OF_ROLE = ": "
CLOSE = "\n</turn>\n"
CONTROL = r"(?:### |</turn>)"
#: A control string with the backslashes before it, from the first of them.
MARKED = rf"(?<!\\)(\\*+{CONTROL})"
ESCAPED = rf"(?<!\\)\\(\\*+{CONTROL})"
BARE = rf"(?<!\\){CONTROL}"
HEAD = rf"\A{OPEN}([^:]*){END_OF_ROLE}"
TRAINED = ("assistant",)
#: A text of conversation -7: a control string, one that looks escaped, and a plain word.
CONFLICT = r"\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, MARKED, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1")


#: From the weakest to the strongest; the first one that reads back is taken.
ESCAPES = (lambda text: text, escape)


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit(END_OF_ROLE))


def render(role: Column, body: Column) -> Column:
    """One turn; ``body`` is an escaped text."""
    return F.concat(header(role), body, F.lit(CLOSE))


def pieces(formatted: Column) -> Column:
    """The turns of a formatted text, without their ends; null where the text doesn't end with a turn."""
    parts = F.split(formatted, CLOSE, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1))


def parse_piece(piece: Column) -> Column:
    """(role, text) of one turn; null where it isn't in the grammar."""
    body = F.regexp_replace(piece, HEAD, "")
    role = F.url_decode(F.regexp_extract(piece, HEAD, 1))
    return F.when(piece.rlike(HEAD) & ~body.rlike(BARE), F.struct(role.alias("role"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """All turns of a formatted text."""
    return F.transform(pieces(formatted), parse_piece)


def body_of(role: Column, text: Column) -> Column:
    """The text in the weakest escape whose rendered turn reads back identical."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    tried = [F.when(parse(render(role, way(text))).eqNullSafe(source), way(text)) for way in ESCAPES]
    return F.coalesce(*tried, F.raise_error(F.lit("a turn doesn't read back in any escape")))


def digest_of(turns: str) -> Column:
    """Hex SHA-256 of role, \\n, text, \\n of every turn."""
    told = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return F.sha2(F.array_join(F.transform(turns, told), ""), 256)


def format_conversations(turns: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """conv_id, n_turns, formatted, loss_mask and source_sha256 (of role, \\n, text, \\n per turn) of every conversation."""
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("body", body_of(F.col("role"), F.col("text")))
    rows = rows.withColumn("skip", F.char_length(header(F.col("role"))).cast("bigint"))
    rows = rows.withColumn("length", F.char_length("body").cast("bigint"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("skip") + F.col("length") + len(CLOSE)
    rows = rows.withColumn("start", F.coalesce(F.sum(whole).over(before), F.lit(0)) + F.col("skip"))
    loss = F.struct("start", F.when(F.col("role").isin(*trained), F.col("length")).otherwise(0).alias("length"))
    turn = F.struct("turn", "role", "text", "start", loss.alias("loss"), "body")
    sorted_ = F.sort_array(F.collect_list(turn))
    return (
        rows.groupBy("conv_id")
        .agg(F.count("*").alias("n_turns"), sorted_.alias("turns"))
        .select(
            "conv_id",
            "n_turns",
            F.array_join(F.transform("turns", lambda t: render(t["role"], t["body"])), "").alias("formatted"),
            F.transform("turns", lambda t: t["loss"]).alias("loss_mask"),
            digest_of("turns").alias("source_sha256"),
        )
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """turn_no, role, text and masked (the text under the loss mask, unescaped) of every turn of the formatted texts.

    The other columns of ``formatted`` stay; they, and those made here, must not clash.
    """
    kept = [c for c in formatted.columns if c not in ("formatted", "loss_mask")]
    found = formatted.withColumn("_pieces", pieces(F.col("formatted")))
    sound = F.when(F.size("_pieces") == F.size("loss_mask"), F.arrays_zip(F.col("_pieces").alias("piece"), F.col("loss_mask").alias("loss")))
    sound = F.coalesce(sound, F.raise_error(F.lit("a conversation doesn't follow the grammar")))
    one = found.select(*kept, F.posexplode(sound).alias("turn_no", "one")).select(*kept, "turn_no", "one.*")
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("piece").cast("bigint") + len(CLOSE)).over(before), F.lit(0))
    one = one.withColumn("_at", F.col("loss.start") - at)
    masked = F.substring(F.col("piece"), (F.col("_at") + 1).cast("int"), F.col("loss.length").cast("int"))
    turn = F.coalesce(parse_piece(F.col("piece")), F.raise_error(F.lit("a turn doesn't follow the grammar")))
    return one.withColumn("_turn", turn).select(*kept, "turn_no", "_turn.*", unescape(masked).alias("masked"))


def format_report(turns: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted texts."""
    formatted = format_conversations(turns, trained).withColumn("formatted_chars", F.char_length("formatted").cast("bigint"))
    read = read_turns(formatted.select("conv_id", "formatted_chars", "source_sha256", "formatted", "loss_mask"))
    sorted_ = F.sort_array(F.collect_list(F.struct("turn_no", "role", "text", "masked")))
    read = read.groupBy("conv_id", "formatted_chars", "source_sha256").agg(F.count("*").alias("n_turns"), sorted_.alias("turns"))
    told = digest_of("turns")
    loss = F.array_join(F.transform("turns", lambda t: t["masked"]), "")
    read = read.select("conv_id", "n_turns", "formatted_chars", "source_sha256", told.alias("told"), loss.alias("loss"))
    same = F.when(F.col("told") == F.col("source_sha256"), F.col("told"))
    return read.select(
        "conv_id",
        "n_turns",
        F.coalesce(same, F.raise_error(F.lit("a conversation doesn't read back"))).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_conflict(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts hold control strings and what looks like escaped ones."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONFLICT).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(more)


SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '{CONFLICT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
rendered AS (
  SELECT *, '### ' || role || ': ' || regexp_replace(text, '(\\*(?:### |</turn>))', '\\\1', 'g') || chr(10) || '</turn>' || chr(10) AS rendered FROM turns),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length(rendered))::bigint AS formatted_chars
  FROM rendered GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""
