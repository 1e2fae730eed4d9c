"""Exact integer centroid clustering with a vantage-point tree over the centroids.

Vectors become integers, floor(scale * x), so every distance, sum and mean is
exact and reruns agree bit for bit.  In each round the driver builds a
vantage-point tree over the centroids (their number is a parameter, so the
tree is small) and broadcasts it.  A node holds a vantage centroid and, for
its near and its far half, the least and the greatest distance from the
vantage centroid.  A vector keeps the open nodes with their lower bounds by the
triangle inequality and visits the one with the least bound first; it stops
when no open bound is within its best distance.  That radius is inclusive, and
bounds are lowered by more than the rounding of their square roots, so that
every centroid that could tie is seen; leaves compare exact integers, and of
equal distances the smaller number wins.  All vectors of a batch walk at once,
each in its own order.

Every task adds up its vectors by cluster before anything is shuffled; per
round the driver collects one row of sums per cluster.  The vectors are
written once to the shared folder, so a lost executor costs its tasks only.

Defined cases: vectors that are null, have another number of components, or
hold null or non-finite ones are left out; a null id is hashed as ``null``;
repeated rows are vectors of their own, and of rows that agree in the hash of
the id the smaller vector comes first; fewer vectors than clusters make fewer
clusters; an empty table gives an empty table; integers beyond 64 bits stop at
their ends, distances that might leave 64 bits are computed with Python's
integers, and a distance or sum that doesn't fit becomes null; other columns
play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.session import materialize

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = "3"
#: Centroids that a leaf of the tree holds at most.
LEAF = 2
#: Rows that walk through the tree at once.
BATCH = 4_096
#: Relative error allowed for in a bound; square roots of doubles are far more exact.
SLACK = 1e-9
LONG = (1 << 63) - 1


class Node(NamedTuple):
    """``members`` are compared exactly; each of ``parts`` is (node, least, greatest distance from the first member)."""

    members: tuple[int, ...]
    parts: tuple[tuple[int, float, float], ...]


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows from a point."""
    gap = rows - point
    return (gap * gap).sum(axis=1)


def root(values: np.ndarray) -> np.ndarray:
    return np.sqrt(values.astype(np.float64))


def vantage_tree(centroids: np.ndarray, leaf: int = LEAF) -> list[Node]:
    """The nodes, the root first; a vantage centroid's near half holds the others up to the median distance."""
    nodes: list[Node | None] = []

    def grow(members: list[int]) -> int:
        here = len(nodes)
        nodes.append(None)
        if len(members) <= leaf:
            nodes[here] = Node(tuple(members), ())
            return here
        # the member farthest from the first one separates best
        far = squared(centroids[members], centroids[members[0]])
        vantage = members[max(range(len(members)), key=lambda i: (far[i], -i))]
        rest = [m for m in members if m != vantage]
        away = root(squared(centroids[rest], centroids[vantage]))
        order = sorted(range(len(rest)), key=lambda i: (away[i], rest[i]))
        half = (len(order) + 1) // 2
        parts = []
        for side in (order[:half], order[half:]):
            if side:
                spans = [float(away[i]) for i in side]
                parts.append((grow([rest[i] for i in side]), min(spans), max(spans)))
        nodes[here] = Node((vantage,), tuple(parts))
        return here

    if len(centroids):
        grow(list(range(len(centroids))))
    return nodes


def assign(rows: np.ndarray, centroids: np.ndarray, nodes: list[Node], seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of every row; ``seen`` collects how many exact distances were computed."""
    n = len(rows)
    best = np.full(n, -1, dtype=np.int64)
    least = np.zeros(n, dtype=rows.dtype)
    bound = np.full((n, len(nodes)), np.inf)
    bound[:, 0] = 0.0
    reach = np.full(n, np.inf)
    walking = np.arange(n)
    while len(walking):
        pick = bound[walking].argmin(axis=1)
        # inclusive: a node whose bound equals the best distance may hold a tie
        open_ = bound[walking, pick] <= reach[walking]
        walking, pick = walking[open_], pick[open_]
        for number in np.unique(pick):
            node, mine = nodes[number], walking[pick == number]
            lower = bound[mine, number]
            bound[mine, number] = np.inf
            first = None
            for member in node.members:
                away = squared(rows[mine], centroids[member])
                if seen is not None:
                    seen.append(len(mine))
                first = away if first is None else first
                closer = (best[mine] < 0) | (away < least[mine]) | ((away == least[mine]) & (member < best[mine]))
                best[mine[closer]] = member
                least[mine[closer]] = away[closer]
            reach[mine] = root(least[mine])
            for part, low, high in node.parts:
                away = root(first)
                gap = np.maximum(low - away, away - high) - SLACK * (away + high + 1.0)
                bound[mine, part] = np.maximum(np.maximum(gap, lower), 0.0)
    return best, least


def widest(dimensions: int) -> int:
    """Components below this number can't take a squared distance out of 64 bits."""
    return 1 << ((62 - (4 * dimensions).bit_length()) // 2)


def as_integers(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of integers; of Python integers where 64 bits might not do for a distance."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    if len(flat) and max(int(flat.max()), -int(flat.min())) >= widest(dimensions):
        return flat.astype(object)
    return flat.astype(np.int64)


def matching(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of one kind, Python integers if one of them is or the centroids need them."""
    if rows.dtype == object or centroids.dtype == object:
        return rows.astype(object), centroids.astype(object)
    return rows, centroids


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """vec_id and q, the integers of the vectors that are kept."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    kept = vectors.filter((F.size(x) == dimensions) & fine)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    return kept.select("vec_id", whole.alias("q"))


def start_key(seed: str = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED, vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids."""
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, dimensions, scale, vector), "integer-vectors")
    starts = rows.withColumn("key", start_key(seed)).orderBy("key", "q").limit(clusters).collect()
    centroids = [list(r.q) for r in starts]
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []

    def broadcast():
        points = np.array(centroids, dtype=object)
        if max(abs(v) for c in centroids for v in c) < widest(dimensions):
            points = points.astype(np.int64)
        return spark.sparkContext.broadcast((points, vantage_tree(points)))

    def batches(found: Iterator[pa.RecordBatch], tree):
        points, nodes = tree.value
        for whole in found:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                q, centres = matching(as_integers(batch.column(batch.schema.get_field_index("q")), dimensions), points)
                yield batch, q, *assign(q, centres, nodes)

    for _ in range(rounds):
        tree = broadcast()

        def totals(found: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            sums, counts = {}, {}
            for _, q, best, _ in batches(found, tree):
                for number in np.unique(best).tolist():
                    mine = q[best == number]
                    counts[number] = counts.get(number, 0) + len(mine)
                    # the sum of a batch fits into 64 bits where its distances do
                    sums[number] = [a + int(b) for a, b in zip(sums.get(number, [0] * dimensions), mine.sum(axis=0), strict=True)]
            parts = sorted(counts)
            yield pa.record_batch(
                [pa.array(np.repeat(np.array(parts, dtype=np.int32), dimensions), pa.int32()), pa.array(list(range(dimensions)) * len(parts), pa.int32()),
                 pa.array([str(v) for p in parts for v in sums[p]], pa.string()), pa.array(np.repeat(np.array([counts[p] for p in parts], dtype=np.int64), dimensions), pa.int64())],
                ["cluster", "place", "total", "rows"],
            )

        added = rows.select("q").mapInArrow(totals, "cluster int, place int, total string, rows bigint")
        added = added.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows"))
        for r in added.collect():
            centroids[r.cluster][r.place] = int(r.total) // int(r.rows)
        tree.destroy()

    tree = broadcast()

    def place(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, best, least in batches(found, tree):
            away = [v if v <= LONG else None for v in map(int, least)] if least.dtype == object else least
            yield pa.record_batch(
                [batch.column(batch.schema.get_field_index("vec_id")), pa.array(best, pa.int32()), pa.array(away, pa.int64())], ["vec_id", "cluster", "distance"]
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(place, f"vec_id {kind}, cluster int, distance bigint"), "placed"), centroids


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    placed, centroids = cluster(vectors, **options)
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    names = vectors.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("one"))
    # one row per cluster: their number is a parameter
    sums = sums.select("cluster", F.expr("try_cast(one AS bigint)").alias("cluster_inertia"), F.expr("try_cast(sum(one) OVER () AS bigint)").alias("inertia"))
    told = sums.join(F.broadcast(names), "cluster")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> str:
    """Every round is two steps: the nearest centroid of each vector, and the floors of the means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT nr, q, n, d FROM (
    SELECT v.nr, v.q, c.n, list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (v.q[i] - c.c[i]) * (v.q[i] - c.c[i])))::bigint AS d,
           row_number() OVER (PARTITION BY v.nr ORDER BY d, c.n) AS place
    FROM vectors v, c{i} c) WHERE place = 1)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.n, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (
    SELECT n, list(((s - ((s % k) + k) % k) // k)::bigint ORDER BY p) AS c FROM (
      SELECT n, p, sum(v) AS s, count(*) AS k FROM (SELECT n, unnest(q) AS v, unnest(range(1, {dimensions + 1})) AS p FROM a{i}) GROUP BY n, p) GROUP BY n) m ON m.n = c.n)""")
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) AS q FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::varchar, 'null')), q) - 1 AS n, q AS c FROM vectors
  QUALIFY n < {clusters}),{",".join(steps)}
SELECT v.vec_id, a.n::int AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.n))::bigint AS cluster_inertia, (sum(a.d) OVER ())::bigint AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN vectors v ON v.nr = a.nr JOIN c{rounds} c ON c.n = a.n
"""


SQL = _sql()
