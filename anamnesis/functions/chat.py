"""Message content: multimodal parts, prefixes, utterances and context lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.functions.text import SILENT_CLASS, estimate_tokens

# --- fixed values: stored placeholders, labels and the context header
AUDIO_OMITTED = "[audio data omitted]"
IMAGE_OMITTED = "[image data omitted]"
ROLES = ["assistant", "user", "system"]
CONTEXT_HEADER = "## 過去の記憶\n以下はユーザーとの過去の会話の記録です。\n\n"
USER_LABEL, CHARACTER_LABEL = "ユーザー", "キャラクター"
CODE_FENCE = "```"
# --- fixed values: where a sentence ends, short and long form
SENTENCE = r".{1,19}?(?:[。．.!?！？\n]|(?=\[))|.{20,}?(?:[、,。．.!?！？\n]|(?=\[))"


def text_parts(parts: Column) -> Column:
    """All text parts joined by a blank."""
    texts = F.filter(parts, lambda p: p["type"] == "text")
    return F.array_join(F.transform(texts, lambda p: p["text"]), " ")


def display_text(parts: Column) -> Column:
    """The first part's text, empty when there is no content."""
    return F.coalesce(F.get(parts, F.lit(0))["text"], F.lit(""))


def stored_parts(parts: Column) -> Column:
    """Content with image data replaced by a placeholder."""
    return F.transform(
        parts,
        lambda p: F.struct(
            p["type"].alias("type"),
            p["text"].alias("text"),
            F.when(p["type"] == "image", F.lit(IMAGE_OMITTED)).otherwise(p["image"]).alias("image"),
        ),
    )


def stored_audio(audio: Column) -> Column:
    return F.when(audio.isNotNull(), F.lit(AUDIO_OMITTED))


def prompt_role(role: Column) -> Column:
    return F.when(role.isin(ROLES), role).otherwise(F.lit("assistant"))


def prompt_text(role: Column, text: Column, user_name: Column, timestamp: Column) -> Column:
    """Text with the comment author of a user row and, if given, the timestamp in front."""
    named = F.when((role == "user") & (F.length(user_name) > 0), F.concat(F.lit("["), user_name, F.lit("さんのコメント] "), text))
    body = F.coalesce(named, text)
    return F.coalesce(F.concat(F.lit("["), timestamp, F.lit("] "), body), body)


def context_line(role: Column, text: Column, stamp: Column | None) -> Column:
    label = F.when(role == "user", USER_LABEL).otherwise(CHARACTER_LABEL)
    line = F.concat(label, F.lit(": "), text)
    return line if stamp is None else F.concat(stamp, F.lit(" "), line)


def packed_context(lines: Column, max_tokens: int) -> Column:
    """Header and the lines (oldest first) that fit, chosen from the newest back.

    A line that does not fit is skipped and older ones are still tried; ''
    when nothing fits.
    """
    header_tokens = estimate_tokens(F.lit(CONTEXT_HEADER))
    room = F.lit(max_tokens) - header_tokens
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("kept"))

    def add(state, line):
        cost = estimate_tokens(F.concat(line, F.lit("\n")))
        fits = state["used"] + cost <= room
        return F.struct(
            F.when(fits, state["used"] + cost).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(F.array(line), state["kept"])).otherwise(state["kept"]).alias("kept"),
        )

    kept = F.aggregate(F.reverse(lines), start, add)["kept"]
    return F.when((room <= 0) | (F.size(kept) == 0), F.lit("")).otherwise(
        F.concat(F.lit(CONTEXT_HEADER), F.array_join(kept, "\n"))
    )


def fenced_segments(text: Column) -> Column:
    """array(struct(code, body)): text outside and inside code fences, in order."""
    return F.transform(
        F.split(text, CODE_FENCE), lambda body, i: F.struct((i % 2 == 1).alias("code"), body.alias("body"))
    )


def spoken_pieces(body: Column) -> Column:
    """array(string): optional emotion tag plus sentence, each as it stands in the text.

    A rest without a sentence end stays whole, its tag included.
    """
    pattern = rf"\G(?:\s*+(?>\[.*?\]\s*)?+(?:{SENTENCE})|(?s:\s*+.+))"
    pieces = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s+", "")), lambda p: F.length(p) > 0)


def piece_emotion(piece: Column) -> Column:
    tag = F.regexp_extract(piece, r"^\s*\[(.*?)\]", 1)
    return F.when(piece.rlike(r"^\s*\[.*?\]"), F.lower(tag)).otherwise(F.lit("neutral"))


def piece_sentence(piece: Column) -> Column:
    """The sentence after its tag; a rest without a sentence end is kept as it is."""
    rest = F.regexp_replace(piece, r"^\s*\[.*?\]\s*", "")
    return F.when(rest.rlike(f"^(?:{SENTENCE})"), rest).otherwise(piece)


def speakable(sentence: Column) -> Column:
    return ~sentence.rlike(f"^{SILENT_CLASS}*$")
