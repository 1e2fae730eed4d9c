"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Documents with equal shingle sets form one class; only classes go on.
2. TREES orders of the signature start at different places.  Classes that
   agree on the first DEPTH values of an order share a region of that tree: two
   sets of similarity 0.8 share none with a probability of 3 in a million.
   Regions of one class, that is most of them, go no deeper.
3. In regions of several classes every order is sorted as a whole by the values
   that follow, and neighbours with their longest common prefix are candidates;
   each class keeps the NEAREST that are neighbours in most orders.  These are
   confirmed on full sets and joined into components: this connects nearly all
   of a group of copies without forming its pairs.
4. What is left are regions that still hold several components.  Only there
   pairs across components are looked at, in blocks of classes: signatures that
   agree well enough make a candidate, confirmed on full sets where the blocks
   are, unless it is connected already.  Nothing is capped: a region with many
   small components just makes many blocks.

Any similarity threshold in (0, 1] may be given; DEPTH and TREES fit 0.8 and
above.  The signature test in step 4 is five standard deviations wide.

Defined cases: a null or empty text, or one of white space, has an empty set
and is linked with nothing; a text of fewer words than a shingle is one
shingle; repeated rows are equal sets; of rows that share doc_id and text one
stays; a row without a doc_id is nobody's original and is never dropped; rows
that share a doc_id stay or go together; an empty table gives an empty table;
extra columns are carried along by ``drop_near_copies``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from anamnesis.llm.base import LOWER, UPPER, WORD, free_name
from anamnesis.llm.components import components
from anamnesis.session import materialize

WORDS = 5
PERCENT = 80
DEPTH, TREES = 5, 32
#: Values after a region's that order its classes.
DEEPER = 4
NEAREST = 3
#: Classes of a block in step 4.
BLOCK = 256
VALUES = DEPTH * TREES

_WORD = re.compile(WORD)
_LOWER = str.maketrans(UPPER, LOWER)
_DRAW = np.random.default_rng(20_011)
_FACTORS = _DRAW.integers(1, 2**63, VALUES, dtype=np.uint64) | np.uint64(1)
_ADDENDS = _DRAW.integers(0, 2**63, VALUES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Shingle sets of texts as sorted arrays of 64-bit hashes; word hashes are remembered."""

    def __init__(self, words: int, remembered: int = 300_000):
        self.words, self.remembered, self.known = words, remembered, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text or "")
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.known) > self.remembered:
            self.known = {}
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxh64_intdigest(word.translate(_LOWER))
        hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.words, len(hashes))
        mixed = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
        for at in range(n):
            mixed = (mixed ^ hashes[at : at + len(mixed)]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


_ROOM = np.empty((128, VALUES), dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), len(_ROOM)):
        some = shingles[at : at + len(_ROOM), None]
        room = _ROOM[: len(some)]
        np.multiply(some, _FACTORS, out=room)
        np.add(room, _ADDENDS, out=room)
        np.minimum(best, room.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingles(words)
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                part = batch.iloc[at : at + 1_000]
                sets = [shingle(text) for text in part["text"]]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"],
                        "n": [len(s) for s in sets],
                        "digest": [_digest(s) for s in sets],
                        "sig": [signature(s).tobytes() if len(s) else None for s in sets],
                    }
                )

    return run


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each class and tree: tree, key of its region, and the values that order it there."""
    for batch in batches:
        for at in range(0, len(batch), 2_000):
            part = batch.iloc[at : at + 2_000]
            sigs = np.frombuffer(b"".join(part["sig"]), dtype=np.uint32).reshape(-1, VALUES)
            rows = []
            for tree in range(TREES):
                order = np.roll(sigs, -tree * DEPTH, axis=1)
                key = np.full(len(sigs), tree, dtype=np.uint64)
                for value in order[:, :DEPTH].T:
                    key = (key ^ value) * _MIX
                    key ^= key >> np.uint64(31)
                deeper = np.ascontiguousarray(order[:, DEPTH : DEPTH + DEEPER].astype(">u4")).view(f"V{4 * DEEPER}").ravel()
                rows.append(pd.DataFrame({"tree": tree, "key": key.view(np.int64), "deeper": [d.tobytes() for d in deeper], "cid": part["cid"].to_numpy()}))
            yield pd.concat(rows)


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbours within a region of a sorted order, with the length of their common prefix."""
    last = None
    for batch in batches:
        if last is not None:
            batch = pd.concat([last, batch])
        last = batch.iloc[-1:]
        if len(batch) < 2:
            continue
        key, cid = batch["key"].to_numpy(), batch["cid"].to_numpy()
        deeper = np.frombuffer(b"".join(batch["deeper"]), dtype=np.uint32).reshape(-1, DEEPER)
        same = np.flatnonzero(key[1:] == key[:-1])
        common = np.minimum.accumulate(deeper[same] == deeper[same + 1], axis=1).sum(axis=1)
        yield pd.DataFrame({"a": cid[same], "b": cid[same + 1], "common": common + DEPTH})


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingles(words)
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                part = batch.iloc[at : at + 1_000]
                rows = [(cid, s.tobytes()) for cid, want, text in zip(part["cid"], part["digest"], part["text"]) if _digest(s := shingle(text)) == bytes(want)]
                yield pd.DataFrame(rows, columns=["cid", "shingles"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for left, right in zip(batch["left"], batch["right"]):
                x, y = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(good, dtype=bool), ["a", "b"]]

    return run


GROUP = ["key", "mixed", "i", "j"]


def _in_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The block pairs of a partition that is sorted by GROUP, one after the other; each has 2 * BLOCK rows or so."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[c].to_numpy() for c in GROUP]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        starts = [0, *new.tolist(), len(batch)]
        if held and any(held[-1][c].iloc[-1] != batch[c].iloc[0] for c in GROUP):
            yield pd.concat(held)
            held = []
        for begin, end in zip(starts[:-2], starts[1:-1]):
            yield pd.concat([*held, batch.iloc[begin:end]]) if held else batch.iloc[begin:end]
            held = []
        held.append(batch.iloc[starts[-2] :])
    if held:
        yield pd.concat(held)


def _candidates(rows: pd.DataFrame, percent: int) -> list[tuple[int, np.ndarray]]:
    """Of a block pair, the rows with the later rows whose component is another and whose signature agrees well enough.

    A pair that meets in several trees belongs to the first one only.  In a block pair with the region's main
    component, its members are the partners of the others.
    """
    if len(rows) < 2:
        return []
    wide = percent / 100
    least = (wide - 5 * (wide * (1 - wide) / VALUES) ** 0.5) * VALUES
    tree, mixed = int(rows["tree"].iloc[0]), bool(rows["mixed"].iloc[0])
    sigs = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint32).reshape(-1, VALUES)
    cid, comp, n, main = (rows[c].to_numpy() for c in ("cid", "comp", "n", "main"))
    lefts = np.flatnonzero(~main) if mixed else np.arange(len(rows))
    rights = np.flatnonzero(main) if mixed else lefts
    out = []
    for i in lefts:
        fits = (comp[rights] != comp[i]) & (100 * np.minimum(n[rights], n[i]) >= percent * np.maximum(n[rights], n[i]))
        other = rights[fits if mixed else fits & (cid[rights] > cid[i])]
        if len(other):
            equal = sigs[other] == sigs[i]
            close = equal.sum(axis=1) >= least
            if close.any():
                first = equal[close].reshape(-1, TREES, DEPTH).all(axis=2).argmax(axis=1) == tree
                if first.any():
                    out.append((int(i), other[close][first]))
    return out


def _with_candidates(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of block pairs that are part of a candidate pair."""
        for rows in _in_groups(batches):
            found = _candidates(rows, percent)
            if found:
                part = sorted({i for i, _ in found}.union(*(others.tolist() for _, others in found)))
                yield rows.iloc[part][[*GROUP, "tree", "cid", "comp", "main", "sig", "n"]]

    return run


def _linked_across(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Confirmed links of block pairs that connect components; candidates that are connected already are left out."""
        for rows in _in_groups(batches):
            sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]]
            cid, comp = rows["cid"].to_numpy(), rows["comp"].to_numpy()
            parent = {c: c for c in comp.tolist()}

            def root(c: int) -> int:
                while parent[c] != c:  # noqa: B023
                    parent[c] = parent[parent[c]]  # noqa: B023
                    c = parent[c]  # noqa: B023
                return c

            out = []
            for i, others in _candidates(rows, percent):
                for j in others.tolist():
                    a, b = root(int(comp[i])), root(int(comp[j]))
                    if a != b:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                            parent[a] = b
                            out.append((min(cid[i], cid[j]), max(cid[i], cid[j])))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("left"), F.length("shingles").alias("n_left"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("right"), F.length("shingles").alias("n_right"))
    sizes = F.least("n_left", "n_right") * 100 >= F.greatest("n_left", "n_right") * percent
    both = pairs.join(left, "a").join(right, "b").filter(sizes).select("a", "b", "left", "right")
    return both.mapInPandas(_confirmed(percent), "a long, b long")


def _links_across(members: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect components, from the regions that hold several.

    First the signatures name the rows of a block pair that have a candidate there; only these get their full sets,
    and the links are confirmed where the block pair is.  So no pair leaves its task before it is a link.
    """
    labelled = members.select("tree", "key", "cid").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left")
    labelled = materialize(labelled.select("tree", "key", "cid", F.coalesce("root", "cid").alias("comp")), "labelled")
    counts = labelled.groupBy("key", "comp").agg(F.count("*").alias("size"))
    regions = counts.groupBy("key").agg(
        F.count("*").alias("comps"), F.sum("size").alias("all"), F.max(F.struct("size", "comp")).alias("top")
    )
    regions = regions.filter("comps > 1").select("key", F.col("top.comp").alias("top"), F.col("top.size").alias("mains"), (F.col("all") - F.col("top.size")).alias("others"))
    regions = materialize(regions, "contested")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("long")
    rows = labelled.join(regions, "key").withColumn("main", F.col("comp") == F.col("top"))
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("main"), blocks("mains")).otherwise(blocks("others")))
    rows = rows.withColumn("own", own).withColumn("n_mains", blocks("mains")).withColumn("n_others", blocks("others"))
    place = "named_struct('mixed', {}, 'i', {}, 'j', {})"
    among = f"transform(sequence(0L, n_others - 1), o -> {place.format('false', 'least(o, own)', 'greatest(o, own)')})"
    against = f"transform(sequence(0L, n_mains - 1), o -> {place.format('true', 'own', 'o')})"
    beside = f"transform(sequence(0L, n_others - 1), o -> {place.format('true', 'o', 'own')})"
    rows = rows.withColumn("at", F.explode(F.expr(f"if(main, {beside}, concat({among}, {against}))")))
    rows = rows.select("key", "at.mixed", "at.i", "at.j", "tree", "cid", "comp", "main").join(classes.select("cid", "sig", "n"), "cid")
    kept = ["key long", "mixed boolean", "i long", "j long", "tree int", "cid long", "comp long", "main boolean", "sig binary", "n long"]
    rows = _dealt(rows).mapInPandas(_with_candidates(percent), ", ".join(kept))
    rows = materialize(rows, "candidates").join(sets, "cid")
    return _dealt(rows).mapInPandas(_linked_across(percent), "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "cid")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (of its shingle set), n_shingles and component_id."""
    signed = docs.select("doc_id", "text").mapInPandas(_signed(words), "doc_id long, n long, digest binary, sig binary")
    signed = materialize(signed, "signatures")
    full = signed.filter("n > 0")
    first = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    classes = materialize(first.withColumn("cid", F.monotonically_increasing_id()), "classes")

    keyed = materialize(classes.select("cid", "sig").mapInPandas(_keyed, "tree int, key long, deeper binary, cid long"), "forest")
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    members = materialize(keyed.join(shared, "key", "left_semi"), "regions")

    ordered = members.select("key", "deeper", "cid").repartitionByRange("key", "deeper", "cid").sortWithinPartitions("key", "deeper", "cid")
    near = ordered.mapInPandas(_neighbours, "a long, b long, common int")
    near = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("common").alias("common"))
    near = materialize(near, "neighbours")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "common"))
    best = both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("common"), "b"))).filter(F.col("rank") <= NEAREST)
    pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    wanted = members.select("cid").distinct().join(classes.select("cid", "rep", "digest"), "cid")
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("cid", "digest", "text")
    sets = materialize(texts.mapInPandas(_sets(words), "cid long, shingles binary").dropDuplicates(["cid"]), "shingles")

    links = materialize(_confirm(pairs, sets, percent), "links")
    more = _links_across(members, components(links), classes, sets, percent)
    roots = components(links.unionByName(materialize(more, "links-across")))

    # the least document of each component of classes
    grouped = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("digest", "rep", F.coalesce("root", "cid").alias("root"))
    grouped = materialize(grouped, "class-components")
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(grouped.join(least, "root").select("digest", "component_id"), "components")
    # large components have few classes each; a class with a third of all rows is joined with one row
    rows = signed.select("doc_id", "digest", "n").join(named, "digest", "left")
    return rows.select("doc_id", "digest", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_report(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    kept: Column = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return near_groups(docs, words, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the least doc_id, with all its columns."""
    groups = near_groups(docs, words, percent).filter("doc_id = component_id")
    identity, digest, rank = (free_name(docs, c) for c in ("kept_id", "digest", "rank"))
    kept = groups.select(F.col("doc_id").alias(identity)).distinct()
    texts = docs.join(kept, F.col("doc_id") == F.col(identity)).withColumn(digest, F.md5(F.coalesce("text", F.lit(""))))
    # the join has brought equal ids together, so repeated rows go without another shuffle
    texts = texts.withColumn(rank, F.row_number().over(Window.partitionBy(identity, digest).orderBy(F.lit(1))))
    return texts.filter(F.col(rank) == 1).select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))
