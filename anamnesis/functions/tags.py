"""Tag visibility and list predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH_MODES = ("any", "all", "any_strict", "all_strict")


def visible(tags: Column, wanted: Column, mode: str = "any") -> Column:
    """Whether a row with ``tags`` passes the filter list ``wanted``.

    The strict modes hide untagged rows, the others keep them; an empty filter
    list lets every row through and an unknown mode counts as ``any``.
    """
    if mode not in MATCH_MODES:
        mode = "any"
    own = F.coalesce(tags, F.array().cast("array<string>"))
    hit = F.arrays_overlap(own, wanted) if mode.startswith("any") else F.size(F.array_except(wanted, own)) == 0
    untagged = F.size(own) == 0
    passes = (~untagged & hit) if mode.endswith("_strict") else (untagged | hit)
    return (F.size(wanted) == 0) | passes


UUID_PATTERN = "(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"


def valid_ids(ids: Column, at_most: int = 10) -> Column:
    """The well-formed UUIDs among the first ``at_most`` requested ids."""
    return F.filter(F.slice(ids, 1, at_most), lambda x: x.rlike(UUID_PATTERN))


def clean_directives(directives: Column) -> Column:
    kept = F.filter(directives, lambda d: d.rlike(r"\S"))
    return F.coalesce(kept, F.array().cast("array<string>"))


def numbered(directives: Column, indent: str = "") -> Column:
    """``1. …`` lines, one per directive."""
    return F.array_join(
        F.transform(directives, lambda d, i: F.concat(F.lit(indent), (i + 1).cast("string"), F.lit(". "), d)), "\n"
    )
