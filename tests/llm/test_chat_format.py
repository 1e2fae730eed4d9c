import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from anamnesis.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = [
    "",
    " ",
    "\\",
    "\\\\",
    "</turn>",
    "\n</turn>\n",
    "\\</turn>",
    "\\\\</turn>\\",
    "### ",
    "### assistant: ",
    "\\### user: x",
    "####  </turn></turn>",
    "a\n</turn",
    "x\n",
    "\n",
    "###",
    "é\U0001f600 ### \u2028",
    "\\" * 5_000 + "### ",
    "\\" * 50_000,
    "$1 \\1 $0",
    "</turn>\n### user: hi\n</turn>\n",
    chat_format.CONFLICT,
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """The report from the rules alone."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        escaped = [re.sub(r"(\\*(?:### |</turn>))", r"\\\1", t[3]) for t in turns]
        size = sum(len(f"### {t[2]}: {e}\n</turn>\n") for t, e in zip(turns, escaped, strict=True))
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss), size)
    return out


def report(spark, rows):
    got = chat_format.format_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got}


def test_hard_texts(spark):
    rows = [(i, t, r, text) for i, text in enumerate(HARD) for t, r in enumerate(("system", "user", "assistant", "user", "assistant"))]
    rows += [(1000, t, ("user", "assistant")[t % 2], text) for t, text in enumerate(HARD)]
    assert report(spark, rows) == plain(rows)


def test_any_mix_of_control_strings(spark):
    draw = random.Random(3)
    parts = ["\\", "### ", "</turn>", "\n", "#", " ", "a", ": ", "</", "turn>"]
    rows = [(i // 5, i % 5, ("user", "assistant")[i % 2], "".join(draw.choices(parts, k=draw.randint(0, 12)))) for i in range(4_000)]
    assert report(spark, rows) == plain(rows)


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, a long conversation, a long text, and clashing columns."""
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "first"), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    rows += [(2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "assistant", "c")]
    rows += [(3, t, ("user", "assistant")[t % 2], f"turn {t} </turn>") for t in range(3_000)]
    rows += [(4, 0, "user", "word \\### " * 50_000), (4, 1, "assistant", "end")]
    turns = spark.createDataFrame(rows, SCHEMA)
    turns = turns.withColumns({c: F.lit("x") for c in ("formatted", "loss_mask", "body", "start", "length", "skip", "turns", "turn_no", "masked", "piece")})
    got = chat_format.format_report(turns).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got} == plain(rows)
    assert chat_format.format_report(turns.limit(0)).collect() == []


def test_roles_keep_their_names(spark):
    names = ["user", "tool: x", "a\nb", "### ", "é %", "</turn>", "Assistant", "_", ""]
    turns = spark.createDataFrame([(0, i, r, "t") for i, r in enumerate(names)], SCHEMA)
    read = chat_format.read_turns(chat_format.format_conversations(turns)).orderBy("turn_no").collect()
    assert [r.role for r in read] == names


def test_plain_texts_are_not_touched(spark):
    """Only turns that don't read back are escaped; the mask covers the trained turns alone."""
    rows = [(0, 0, "user", "a \\ b"), (0, 1, "assistant", "c"), (0, 2, "user", "d </turn>")]
    made = chat_format.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert made.formatted == "### user: a \\ b\n</turn>\n### assistant: c\n</turn>\n### user: d \\</turn>\n</turn>\n"
    assert [made.formatted[m.start : m.start + m.length] for m in made.loss_mask] == ["", "c", ""]


def test_conflicting_conversation(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)
    rows = chat_format.with_conflict(spark, turns).collect()
    assert Counter(r.text for r in rows if r.conv_id == -7) == {"\\### Assistant: </turn> ok": 2}


def test_text_outside_the_grammar(spark):
    texts = ["", "### a: b\n</turn>\n", "### a: b", "### a b\n</turn>\n", "### a: ### \n</turn>\n", "### a: \\### \n</turn>\n", "x### a: b\n</turn>\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", chat_format.parse(F.col("t")).alias("p"))
    got = {r.i: r.p and [x and (x.role, x.text) for x in r.p] for r in rows.collect()}
    assert got == {0: [], 1: [("a", "b")], 2: None, 3: [None], 4: [None], 5: [("a", "### ")], 6: [None]}
