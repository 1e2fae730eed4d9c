"""Text functions: grams, keywords, token estimates, tags and cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: phrases removed from a query before it is split into keywords
COMPOUND_PARTICLES = [
    "について", "に関して", "に関する", "に対して", "に対する",
    "のこと", "ということ", "といった", "のような", "みたいな",
    "における", "としての", "によると", "によって",
    "ですか", "ですが", "ですね", "ですよ", "でした",
    "ました", "ません", "ている", "ていた", "てください",
    "しました", "しています", "してた", "してる",
    "ってなに", "ってどう", "って何",
    "だった", "だっけ", "かな", "かも",
    "知って", "教えて", "覚えて", "思い出して",
]
SINGLE_PARTICLES = "はがのをにでともやへか"
# --- fixed values: emotions a tag may name
EMOTIONS = ["neutral", "happy", "angry", "sad", "relaxed", "surprised"]
# --- fixed values: characters a sentence may consist of without being speakable
EMOJI_CLASS = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F1E0}-\x{1F1FF}]"
SYMBOL_CLASS = (
    r"""[!?.,。、．，'"(){}\[\]<>+=\-*\/\\|;:@#$%^&*_~！？（）「」『』【】〔〕［］｛｝〈〉《》｢｣：；＋－＊／＝＜＞％＆＾｜～＠＃＄＿”　]"""
)
SILENT_CLASS = (
    r"""[\s　\[\(\{「［（【『〈《〔｛«‹〘〚〛〙›»〕》〉』】）］」\}\)\]'"‘’“”・、。,.!?！？:：;；\-_=+~～*＊@＠#＃$＄%％^＾&＆|｜\\＼/／`｀]"""
)
# --- fixed values: limits
MIN_KEYWORD_CHARS = 2
WHOLE_QUERY_CHARS = 20
CHARS_PER_TOKEN = 3
MAX_INPUT_CHARS = 200


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def bigrams(text: Column) -> Column:
    """Distinct character pairs of the words, each word blank-padded."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(" "))
    pairs = F.regexp_extract_all(padded, F.lit(r"(?s)(?=(..))"), F.lit(1))
    return F.when(F.length(F.trim(padded)) == 0, empty_strings()).otherwise(F.array_distinct(pairs))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Shared pairs over the larger number of pairs."""
    return gram_overlap(bigrams(a), bigrams(b))


def gram_overlap(a: Column, b: Column) -> Column:
    larger = F.greatest(F.size(a), F.size(b))
    return F.when(larger > 0, F.size(F.array_intersect(a, b)) / larger).otherwise(F.lit(0.0))


def trigrams(text: Column) -> Column:
    """Distinct lower-case triples of each word padded two before, one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    triples = F.flatten(F.transform(padded, lambda w: F.regexp_extract_all(w, F.lit("(?=(...))"), F.lit(1))))
    return F.array_distinct(triples)


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard overlap of the two trigram sets."""
    left, right = trigrams(a), trigrams(b)
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def extract_keywords(query: Column) -> Column:
    """Search keywords of a query, in order of first appearance.

    The compound phrases go one after the other, longest first: a single
    alternation would resolve overlapping phrases differently.
    """
    text = query
    for phrase in sorted(COMPOUND_PARTICLES, key=len, reverse=True):
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    tokens = F.split(text, rf"(?U)[{SINGLE_PARTICLES}\s]+")
    kept = F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= MIN_KEYWORD_CHARS))
    whole = F.when(F.length(query) <= WHOLE_QUERY_CHARS, F.array(query)).otherwise(empty_strings())
    return F.when(F.size(kept) > 0, kept).otherwise(whole)


def estimate_tokens(text: Column) -> Column:
    """Kana/kanji at 1.5 characters, ASCII at 4, all else 1 UTF-16 unit a token."""
    japanese = F.regexp_count(text, F.lit(r"[぀-ゟ゠-ヿ一-龯]"))
    ascii_ = F.regexp_count(text, F.lit(r"[\x00-\x7F]"))
    units = F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    total = F.ceil(japanese / 1.5) + F.ceil(ascii_ / 4) + (units - japanese - ascii_)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), total)).cast(
        "bigint"
    )


def recall_chars(text: Column, context: Column) -> Column:
    return F.length(text) + F.coalesce(F.length(context), F.lit(0))


def embedding_text(text: Column, event_date: Column) -> Column:
    dated = F.concat(text, F.lit(" (happened on "), F.date_format(event_date, "yyyy-MM-dd"), F.lit(")"))
    return F.coalesce(dated, text)


def rerank_text(text: Column, context: Column, occurred_start: Column) -> Column:
    body = F.when(F.length(context) > 0, F.concat(context, F.lit(": "), text)).otherwise(text)
    dated = F.concat(F.lit("[Date: "), F.date_format(occurred_start, "yyyy-MM-dd"), F.lit("] "), body)
    return F.coalesce(dated, body)


def split_sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[。．！？\n])"), lambda s: F.length(s) > 0)


def emotion_tag(text: Column) -> Column:
    """struct(emotion, body): the leading ``[tag]``, lower-cased, and what follows it."""
    tag = F.lower(F.regexp_extract(text, r"^\s*\[(.*?)\]", 1))
    return F.struct(
        F.when(text.rlike(r"^\s*\[.+?\]"), tag).otherwise(F.lit("neutral")).alias("emotion"),
        F.regexp_replace(text, r"^\s*\[.*?\]\s*", "").alias("body"),
    )


def idle_phrase(text: Column) -> Column:
    """struct(emotion, body): unknown emotions become neutral, every tag is removed."""
    tag = F.lower(F.regexp_extract(text, r"^\s*\[(.*?)\]", 1))
    return F.struct(
        F.when(tag.isin(EMOTIONS), tag).otherwise(F.lit("neutral")).alias("emotion"),
        strip(F.regexp_replace(text, r"\[.*?\]", "")).alias("body"),
    )


def clean_text(text: Column) -> Column:
    """Text without emoji; NULL when nothing but symbols is left."""
    bare = F.regexp_replace(strip(text), EMOJI_CLASS, "")
    return F.when((F.length(bare) > 0) & ~bare.rlike(f"^{SYMBOL_CLASS}+$"), bare)


def substitute_terms(text: Column, readings: dict[str, str]) -> Column:
    """Replace whole words, case-insensitively, by their reading.

    ``readings`` is a driver-side word list; it becomes one map literal.
    """
    pairs = [F.lit(x) for word, reading in readings.items() for x in (word.lower(), reading)]
    lookup = F.create_map(*pairs)
    pieces = F.regexp_extract_all(text, F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(lookup, F.lower(p)), p)), "")


def parse_word_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda w: strip(w)), lambda w: F.length(w) > 0)


def input_problem(text: Column, blocked: Column, max_chars: int = MAX_INPUT_CHARS) -> Column:
    """'too_long', 'blocked_word' or NULL for valid input; empty input is valid."""
    found = F.exists(blocked, lambda w: F.contains(F.lower(text), F.lower(w)))
    return F.when(F.length(text) > max_chars, "too_long").when((F.length(text) > 0) & found, "blocked_word")


def salvage_json_array(text: Column) -> Column:
    """JSON text of the array in a model answer, ``[]`` when there is none.

    The whole answer if it parses as an array, else the first bracket-balanced
    ``[...]`` in it.
    """
    body = strip(text)
    tail = F.substring(body, F.locate("[", body), F.length(body))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("end"))

    def step(state, char):
        depth = (
            state["depth"] + F.when(char == "[", F.lit(1)).when(char == "]", F.lit(-1)).otherwise(F.lit(0))
        )
        closed = (depth == 0) & (state["end"] == 0)
        return F.struct(
            depth.alias("depth"),
            (state["pos"] + 1).alias("pos"),
            F.when(closed, state["pos"] + 1).otherwise(state["end"]).alias("end"),
        )

    end = F.aggregate(F.split(tail, ""), start, step)["end"]
    piece = F.when((F.locate("[", body) > 0) & (end > 0), F.substring(tail, F.lit(1), end))
    whole = F.when(body.startswith("[") & F.json_array_length(body).isNotNull(), body)
    part = F.when(F.json_array_length(piece).isNotNull(), piece)
    return F.coalesce(whole, part, F.lit("[]"))
