"""Prompt sections built from a bank's disposition, directives and mission."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.functions.tags import clean_directives, numbered

# --- fixed values: axis default and range, guidance texts for a high and a low axis
AXIS_DEFAULT, AXIS_MIN, AXIS_MAX = 3, 1, 5
GUIDANCE = {
    "skepticism": (
        "主張に懐疑的に対応してください。矛盾する証拠を積極的に探し、裏付けのない主張には注意を促してください。",
        "提供された情報を信頼し、額面通りに受け取ってください。特に疑わしい点がなければ追加検証は不要です。",
    ),
    "literalism": (
        "文字通りに解釈してください。正確な約束、具体的な数値、明示的に述べられた事実に注目してください。",
        "行間を読み、暗示的な意味を考慮してください。文脈から推測される意図やニュアンスも回答に反映してください。",
    ),
    "empathy": (
        "感情状態や置かれた状況を考慮してください。共感的な視点を持ち、心理的な側面にも注目してください。",
        "事実と結果に焦点を当ててください。客観的なデータと論理的な分析を優先してください。",
    ),
}
GUIDANCE_HEAD = "## 推論ガイダンス\n\n"
DIRECTIVE_HEAD = "## ディレクティブ（必須）\n\n以下は必ず遵守しなければならないルールです。他の指示よりも優先されます。\n\n"
DIRECTIVE_FOOT = "\n\nこれらのディレクティブに違反することは、いかなる状況でも許可されません。\n"
REMINDER_HEAD = "---\n\n**回答前の確認**: 以下のディレクティブを遵守していることを確認してください:\n\n"
SUMMARY_REQUEST = "について、これまでの全ての記憶から包括的にまとめてください。"


def axis(value: Column) -> Column:
    """An axis as an integer 1..5; anything unusable is the neutral 3."""
    number = F.coalesce(value.try_cast("int"), F.lit(AXIS_DEFAULT))
    return F.greatest(F.lit(AXIS_MIN), F.least(F.lit(AXIS_MAX), number))


def guidance_lines(skepticism: Column, literalism: Column, empathy: Column) -> Column:
    """At most one line per axis: high from 4, low to 2, none in between."""
    lines = []
    for value, (high, low) in zip((skepticism, literalism, empathy), GUIDANCE.values(), strict=True):
        level = axis(value)
        lines.append(F.when(level >= 4, F.lit(high)).when(level <= 2, F.lit(low)))
    return F.array_compact(F.array(*lines))


def guidance_section(skepticism: Column, literalism: Column, empathy: Column) -> Column:
    lines = F.transform(guidance_lines(skepticism, literalism, empathy), lambda s: F.concat(F.lit("- "), s))
    return F.when(F.size(lines) == 0, F.lit("")).otherwise(
        F.concat(F.lit(GUIDANCE_HEAD), F.array_join(lines, "\n"), F.lit("\n"))
    )


def directive_section(directives: Column) -> Column:
    kept = clean_directives(directives)
    return F.when(F.size(kept) == 0, F.lit("")).otherwise(
        F.concat(F.lit(DIRECTIVE_HEAD), numbered(kept), F.lit(DIRECTIVE_FOOT))
    )


def directive_reminder(directives: Column) -> Column:
    kept = clean_directives(directives)
    return F.when(F.size(kept) == 0, F.lit("")).otherwise(
        F.concat(F.lit(REMINDER_HEAD), numbered(kept, "  "), F.lit("\n"))
    )


def source_query(name: Column, mission: Column) -> Column:
    """The question a summary of an entity answers."""
    plain = F.concat(name, F.lit(SUMMARY_REQUEST))
    aimed = F.concat(plain, F.lit("ミッション「"), mission, F.lit("」の観点を含めてください。"))
    return F.when(F.length(mission) > 0, aimed).otherwise(plain)
