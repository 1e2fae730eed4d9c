"""Merkle manifest of a dataset, and proofs found by descending a content-addressed store.

Every row is a leaf.  The leaves of one tree (here: of one language) ascend by
their order columns; every ``fanout`` consecutive nodes become the digest of
their digests until one node remains, and the remaining nodes of all trees are
the leaves of one more tree, whose last node is the root of the dataset.

The store has one record per ``levels`` levels: a node's digest and, as its
children, the digests of the nodes that many levels below it.  The levels
between are computed from the children whenever a record is read, and must
lead to its name again.  A leaf's place, written to base fanout ** levels,
names the child to go to in each record; requests enter at the root, look up
the record of the digest they stand on, keep the siblings on the way to the
child (one path segment), and go on from the child's digest.  At the leaf the
segments are reversed, which gives the proof from the leaf up.

Requests that stand on one node go down together, one row per node, and part
at the children, so the records near the root are not met by every leaf.
Places come from a range partitioning and the sizes of its parts; a tree with
a third of all rows is spread over many tasks.  The driver learns the height
of the highest tree only.

Defined cases: null fields are written as ``-`` and differ from empty ones;
null order values and the null tree come first; rows that agree in the order
columns ascend by their leaf digest; repeated rows are leaves of their own; a
tree of one leaf is that leaf; an empty table gives empty tables; extra
columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.session import materialize

FANOUT = 2
#: Levels that one record spans.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Documents whose hash this number divides are tampered with in the report.
TAMPER = 7


class Manifest(NamedTuple):
    """``leaves``: tree, rank, height, leaf and the payload; ``records``: digest, levels, children, one table per depth
    (the lowest first); ``roots``: tree, depth, node.  ``above`` is the manifest of the trees' roots."""

    leaves: DataFrame
    records: list[DataFrame]
    roots: DataFrame
    above: Manifest | None
    fanout: int
    levels: int


def field(value: Column) -> Column:
    """A value so that neither null and empty nor the ends of fields can be mistaken."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    return digest(*map(field, fields))


def tree_key(value: Column) -> Column:
    """A text that is never null and sorts like ``value``, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: Sequence[str], fanout: int) -> DataFrame:
    """Add rank (from 0, in the order of the columns inside ``tree``) and height (levels above the leaves of the tree)."""
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    dealt = materialize(dealt, "merkle-leaves")
    whole = Window.partitionBy("tree")
    before = F.sum("_size").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    size = F.sum("_size").over(whole)
    about = F.ceil(F.log("_all") / F.log(F.lit(float(fanout)))).cast("int")
    # the logarithm may be off by a hair at powers of fanout
    height = about + F.when(F.pow(F.lit(float(fanout)), about) < F.col("_all"), 1).when((about > 0) & (F.pow(F.lit(float(fanout)), about - 1) >= F.col("_all")), -1).otherwise(0)
    runs = dealt.groupBy("tree", "_part").agg(F.count("*").alias("_size"), F.min("_place").alias("_first"))
    runs = runs.select("tree", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), size.alias("_all"))
    runs = runs.select("tree", "_part", (F.col("_before") - F.col("_first")).alias("_shift"), height.alias("height"))
    joined = dealt.join(runs, ["tree", "_part"])
    return joined.withColumn("rank", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def parents(nodes: Column, fanout: int) -> Column:
    """The next level of an array of digests."""
    at = lambda i, j: F.get(nodes, i * fanout + j)
    run = lambda i: digest(at(i, 0), *[F.coalesce(at(i, j), F.lit("")) for j in range(1, fanout)])
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / fanout).cast("int") - 1), run)


def climb(children: Column, levels: Column, fanout: int) -> Column:
    """The levels of a record, from the children up to its own node."""
    return F.aggregate(F.sequence(F.lit(1), levels), F.array(children), lambda done, _: F.concat(done, F.array(parents(F.element_at(done, -1), fanout))))


def segment(nodes: Column, levels: Column, digit: Column, fanout: int) -> Column:
    """What stands before and after the way from child ``digit`` up to the record's node, level by level."""

    def beside(level: Column) -> Column:
        row = F.element_at(nodes, level + 1)
        place = F.floor(digit / F.pow(F.lit(fanout), level)).cast("int")
        mine = place % fanout
        at = lambda j: F.coalesce(F.get(row, place - mine + j), F.lit(""))
        before = [F.when(mine > j, at(j)).otherwise("") for j in range(fanout - 1)]
        after = [F.when(mine < j, at(j)).otherwise("") for j in range(1, fanout)]
        return F.struct(F.concat(*before).alias("before"), F.concat(*after).alias("after"))

    return F.transform(F.sequence(F.lit(0), levels - 1), beside)


def _store(leaves: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Records of every depth, and the last node of every tree with the number of records above its leaves."""
    tallest = leaves.agg(F.max("height")).first()[0] or 0
    nodes = leaves.select("tree", "rank", "height", F.col("leaf").alias("node"))
    records, roots = [], nodes.filter("height = 0").select("tree", F.lit(0).alias("depth"), "node")
    for depth in range(1, -(-tallest // levels) + 1):
        parts = nodes.filter("height > 0").withColumn("_digit", F.col("rank") % fanout**levels)
        children = F.transform(F.sort_array(F.collect_list(F.struct("_digit", "node"))), lambda x: x["node"])
        made = parts.groupBy("tree", "height", F.floor(F.col("rank") / fanout**levels).alias("rank")).agg(children.alias("children"))
        made = made.withColumn("levels", F.least("height", F.lit(levels)))
        top = F.element_at(F.element_at(climb(F.col("children"), F.col("levels"), fanout), -1), 1)
        made = materialize(made.withColumn("digest", top), "merkle-records")
        records.append(made.select("digest", "levels", "children"))
        nodes = made.select("tree", "rank", (F.col("height") - F.col("levels")).alias("height"), F.col("digest").alias("node"))
        roots = roots.unionByName(nodes.filter("height = 0").select("tree", F.lit(depth).alias("depth"), "node"))
    return records, roots


def manifest(rows: DataFrame, order: Sequence[str], fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """Trees over ``rows`` (tree, leaf, the order columns and any payload), and one more over the roots of the trees."""
    leaves = ranked(rows, [*order, "leaf"], fanout)
    records, roots = _store(leaves, fanout, levels)
    roots = materialize(roots, "merkle-roots")
    ends = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("node").alias("leaf")), ["of"], fanout)
    above_records, above_roots = _store(ends, fanout, levels)
    above = Manifest(ends, above_records, materialize(above_roots, "merkle-root"), None, fanout, levels)
    return Manifest(leaves, records, roots, above, fanout, levels)


def descend(store: Manifest, payload: Sequence[str], starts: DataFrame) -> DataFrame:
    """Go down from ``starts`` (tree, depth, node, segments and more) to every leaf of the store.

    Returns the payload, the columns of ``starts`` without depth, ``node`` (now the leaf's digest) and ``segments``
    with one segment per record on the way added.
    """
    base, fanout = store.fanout**store.levels, store.fanout
    more = [c for c in starts.columns if c not in ("tree", "depth", "node", "segments")]
    digit = (F.col("rank") % base).cast("int").alias("digit")
    prefix = F.floor(F.col("rank") / base).alias("rank")
    single = store.leaves.filter("height = 0").select("tree", F.struct(F.lit(0).alias("digit"), *payload).alias("asked"))
    single = single.join(starts.filter("depth = 0"), "tree").select("tree", "asked.*", "node", "segments", *more).drop("digit")
    if not store.records:
        return single
    asked = store.leaves.filter("height > 0").select("tree", prefix, F.struct(digit, *payload).alias("one"))
    asked = [materialize(asked.groupBy("tree", "rank").agg(F.collect_list("one").alias("asked")), "merkle-requests")]
    for _ in store.records[1:]:
        upper = asked[-1].select("tree", prefix, F.struct(digit).alias("one"))
        asked.append(upper.groupBy("tree", "rank").agg(F.collect_list("one").alias("asked")))

    def enter(depth: int) -> DataFrame:
        return starts.filter(F.col("depth") == depth).select("tree", F.lit(0).cast("bigint").alias("rank"), "node", "segments", *more)

    here = enter(len(store.records))
    for depth in range(len(store.records), 0, -1):
        records = store.records[depth - 1].dropDuplicates(["digest"])
        met = here.join(asked[depth - 1], ["tree", "rank"]).join(records, F.col("node") == F.col("digest"))
        met = met.withColumn("nodes", climb(F.col("children"), F.col("levels"), fanout))
        part = lambda a: F.struct(a.alias("a"), F.get("children", a["digit"]).alias("node"), segment(F.col("nodes"), F.col("levels"), a["digit"], fanout).alias("part"))
        sound = F.element_at(F.element_at("nodes", -1), 1) == F.col("digest")
        down = F.explode(F.when(sound, F.transform("asked", part)).otherwise(F.raise_error(F.lit("a record doesn't match its digest"))))
        met = met.select("tree", "rank", "segments", *more, down.alias("x"))
        grown = F.concat("segments", F.array("x.part")).alias("segments")
        if depth == 1:
            here = met.select("tree", *[f"x.a.{c}" for c in payload], "x.node", grown, *more)
        else:
            here = met.select("tree", (F.col("rank") * base + F.col("x.a.digit")).alias("rank"), "x.node", grown, *more)
            here = here.unionByName(enter(depth - 1))
    return here.unionByName(single)


def proofs(store: Manifest, payload: Sequence[str] = ()) -> DataFrame:
    """The payload of every leaf with leaf, subroot, root and ``path``: (before, after) of each level, from the leaf up."""
    nothing = F.array().cast("array<array<struct<before:string,after:string>>>")
    entry = store.above.roots.select("tree", "depth", "node", nothing.alias("segments"), F.col("node").alias("root"))
    tops = descend(store.above, ["of"], entry).select(F.col("of").alias("tree"), "segments", "root")
    starts = store.roots.join(tops, "tree").withColumn("subroot", F.col("node"))
    found = descend(store, payload, starts)
    path = F.flatten(F.reverse("segments")).alias("path")
    return found.select(*payload, F.col("node").alias("leaf"), "subroot", "root", path)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def document_leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, and ``changed``: the leaf with n_chars one higher, where TAMPER divides the CRC-32 of doc_id."""
    fields = [F.col(c) for c in FIELDS]
    higher = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0
    return docs.select(tree_key(F.col("lang")).alias("tree"), "doc_id", leaf_digest(fields).alias("leaf"), F.when(hit, leaf_digest(higher)).alias("changed"))


def merkle_report(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    leaves = materialize(document_leaves(docs), "merkle-digests")
    found = proofs(manifest(leaves, ["doc_id"], fanout, levels), ["doc_id", "changed"])
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    rows = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _sql_leaf(fields: Sequence[str]) -> str:
    return f"sha256({' || '.join(map(_sql_field, fields))})"


#: The CRC-32 is computed bit by bit.
SQL = f"""
WITH RECURSIVE crc AS (
  SELECT *, row_number() OVER () AS nr,
         xor(4294967295, list_reduce([4294967295]::bigint[] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
             lambda c, b: list_reduce([xor(c, b)] || range(8), lambda d, i: xor(d >> 1, CASE WHEN d % 2 = 1 THEN 3988292384 ELSE 0 END)))) AS crc
  FROM documents),
leaves AS (
  SELECT nr, doc_id, lang, {_sql_leaf(FIELDS)} AS leaf,
         CASE WHEN crc % {TAMPER} = 0 THEN {_sql_leaf([f'({c} + 1)' if c == 'n_chars' else c for c in FIELDS])} END AS changed
  FROM crc),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low AS (
  SELECT lang, 0 AS level, place, leaf AS node, n FROM placed
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, level, place // 2, n),
subs AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, place, subroot AS node, n FROM subs
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, place // 2, n),
steps AS (
  SELECT p.nr, l.level, l.place, s.place AS other, s.node
  FROM placed p JOIN low l ON l.lang IS NOT DISTINCT FROM p.lang AND l.n > 1 AND l.place = p.place >> l.level
  LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = l.level AND s.place = xor(l.place, 1)
  UNION ALL
  SELECT p.nr, 100 + h.level, h.place, s.place, s.node
  FROM placed p JOIN subs b ON b.lang IS NOT DISTINCT FROM p.lang JOIN high h ON h.n > 1 AND h.place = b.place >> h.level
  LEFT JOIN high s ON s.level = h.level AND s.place = xor(h.place, 1)),
paths AS (
  SELECT nr, string_agg(coalesce(node, ''), '' ORDER BY level) AS siblings,
         list(CASE WHEN other < place THEN '<' || node WHEN other > place THEN '>' || node ELSE '-' END ORDER BY level) AS steps
  FROM steps GROUP BY nr),
folded AS (
  SELECT p.doc_id, p.leaf, b.subroot, (SELECT node FROM high WHERE n = 1) AS root, sha256(coalesce(t.siblings, '')) AS proof_sha256,
         list_reduce([coalesce(p.changed, p.leaf)] || coalesce(t.steps, []),
             lambda h, s: sha256(CASE s[1] WHEN '<' THEN s[2:] || h WHEN '>' THEN h || s[2:] ELSE h END)) AS folded_root
  FROM placed p JOIN subs b ON b.lang IS NOT DISTINCT FROM p.lang LEFT JOIN paths t ON t.nr = p.nr)
SELECT *, folded_root = root AS verified FROM folded
"""
