import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=8, rounds=10, dims=64, scale=1024):
    """The report from the rules alone, in Python integers."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in v]))
    key = lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [q for _, q in sorted(kept, key=key)[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        found = {}
        for _, q in kept:
            found.setdefault(nearest(q)[1], []).append(q)
        for i, mine in found.items():
            centres[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    placed = [(vec_id, *nearest(q)) for vec_id, q in kept]
    inertia = Counter()
    for _, d, i in placed:
        inertia[i] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((vec_id, i, d, inertia[i], sum(inertia.values()), names[i]) for vec_id, d, i in placed)


def report(df, **options):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return Counter(tuple(r[n] for n in names) for r in centroids.cluster_report(df, **options).collect())


def test_some_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert report(table.repartition(5)) == plain(rows)


def test_odd_rows(spark):
    draw = random.Random(1)
    some = [[draw.choice([-0.5, 0.0, 0.25]) for _ in range(4)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(some)] + [(3, some[3])] * 4 + [(None, some[0]), (None, some[1])]
    rows += [(100, None), (101, []), (102, [1.0] * 3), (103, [None] * 4), (104, [float("nan")] + [0.0] * 3), (105, [float("inf")] + [0.0] * 3), (106, [-1e-9] * 4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    df = df.withColumns({c: F.lit("x") for c in ("q", "cluster", "distance", "key", "total", "one", "inertia")})
    assert report(df, dimensions=4) == plain(rows, dims=4)
    few = df.filter("vec_id in (1, 2)")
    assert report(few, dimensions=4) == plain([r for r in rows if r[0] in (1, 2)], dims=4)
    assert report(df.limit(0)) == Counter()
    assert centroids.cluster_report(df.limit(0)).columns == centroids.cluster_report(few, dimensions=4).columns


def test_ties_go_to_the_smaller_number(spark):
    """Copies make equal centroids; points half way between two are tied."""
    rows = [(i, [float(i % 3), 0.0]) for i in range(40)] + [(100 + i, [0.5, 0.0]) for i in range(5)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for rounds in (0, 1, 4):
        assert report(df, dimensions=2, rounds=rounds) == plain(rows, rounds=rounds, dims=2)


def test_large_components(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([[1e15, 3.0], [-1e15, 2.0], [1e15, 0.0], [5.0, 5.0], [2e15, 1.0]])]
    got = report(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), dimensions=2, clusters=2, rounds=2)
    want = plain(rows, k=2, rounds=2, dims=2)
    fit = lambda v: v if v <= centroids.LONG else None
    assert {(r[0], r[1], r[2], r[5]) for r in got} == {(r[0], r[1], fit(r[2]), r[5]) for r in want}


@pytest.mark.parametrize("spread", [1, 50, 3_000])
def test_tree_against_all_distances(spread):
    """Nearest and number of every row, ties included, from fewer distances where the centroids lie apart."""
    draw = np.random.default_rng(spread)
    points = draw.integers(-1, 2, (300, 3)) if spread == 1 else draw.integers(-spread, spread, (300, 3))
    rows = np.concatenate([draw.integers(-spread, spread + 1, (2_000, 3)), points])
    seen = []
    best, least = centroids.assign(rows, points, centroids.vantage_tree(points), seen)
    away = ((rows[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (least == away.min(axis=1)).all()
    assert (best == away.argmin(axis=1)).all()
    if spread > 1:
        assert sum(seen) < 0.5 * away.size
