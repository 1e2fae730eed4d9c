"""The graph walk against plain Python, and what it shuffles."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from anamnesis.operators import walk
from anamnesis.operators.links import EDGES_PER_TYPE

LINKS = "bank_id bigint, from_unit_id bigint, to_unit_id bigint, link_type string, weight double, entity_id bigint"
SEEDS = "query_id bigint, node bigint, score double"
KINDS = ["semantic", "entity", "temporal", "causes", "caused_by"]


def graph(seed=3):
    draw = random.Random(seed)
    links = {(0, draw.randrange(40), draw.randrange(40), draw.choice(KINDS)) for _ in range(700)}
    links = [(*e, round(draw.uniform(0.05, 1), 3), None) for e in sorted(links)]
    seeds = [(q, n, round(draw.random(), 3)) for q in range(9) for n in draw.sample(range(45), 3)]
    return links, seeds, [(q, n, 0.0) for q, n, _ in seeds if q % 2]


def plain(links, jobs):
    edges = defaultdict(list)
    for _, a, b, kind, weight, _ in links:
        if weight >= 0.1:
            edges[a, kind].append((weight, b))
    share = {}
    for key, rows in edges.items():
        best = sorted(rows, key=lambda r: (-r[0], r[1]))[:EDGES_PER_TYPE]
        total = sum(w for w, _ in best)
        share[key] = [(b, w / total) for w, b in best]
    out = defaultdict(float)
    for seeds, patterns, first in jobs:
        by_query = defaultdict(list)
        for q, n, s in seeds:
            by_query[q].append((n, s))
        for q, rows in by_query.items():
            total = sum(s for _, s in rows)
            for i, hops in enumerate(patterns, first):
                mass = defaultdict(float)
                for n, s in rows:
                    mass[n] += s / total if total else 1 / len(rows)
                for hop in hops:
                    pushed = defaultdict(float)
                    for n, m in mass.items():
                        if m >= walk.MIN_MASS:
                            out[q, i, n] += walk.KEPT * m
                            for b, part in share.get((n, hop), ()):
                                pushed[b] += (1 - walk.KEPT) * m * part
                    mass = pushed
                for n, m in mass.items():
                    if m >= walk.MIN_MASS:
                        out[q, i, n] += m
    return out


def test_walk_against_plain_python(spark):
    links, seeds, timed = graph()
    got = walk.walk(spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(links, LINKS), spark.createDataFrame(timed, SEEDS))
    found = {(r.query_id, r.pattern, r.node): r.score for r in got.collect()}
    want = plain(links, [(seeds, walk.SEMANTIC_PATTERNS, 0), (timed, walk.TEMPORAL_PATTERNS, len(walk.SEMANTIC_PATTERNS))])
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_reached_nodes_are_shuffled_once_and_packed(spark):
    """Everything after the last hop works inside one task a query: one shuffle by query, of packed edges."""
    links, seeds, _ = graph()
    found = walk.graph_search(spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(links, LINKS))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(query_id", plan)) == 1
    assert len(found.select("query_id").distinct().collect()) == 9 and found.agg(F.max("rn")).first()[0] <= walk.RESULT_LIMIT
