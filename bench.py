"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the tables and the cores.  Every query computes all of its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from anamnesis.catalog.all import REGISTRY, Tables  # noqa: E402
from anamnesis.session import local_session  # noqa: E402

HEADLINE = [
    "semantic_search",
    "keyword_search",
    "temporal_search",
    "graph_rrf",
    "recall",
    "build_links",
    "temporal_links_events",
    "entity_links",
    "cooccurrence",
    "resolve_entities",
    "retain_keep",
    "freshness",
    "consolidation_stats",
    "model_exists",
    "memory_search_wide",
    "bigram_similarity",
    "last_messages",
    "msg_normalize",
    "context_build",
    "continuity_state",
    "client_queue",
    "idle_gaps",
    "presence_intervals",
    "chunk_assemble",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "anamnesis-bench")
    # start the JVM's and the Python workers' machinery before the clock
    REGISTRY["semantic_search"].build(Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        REGISTRY[name].build(Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    total = round(sum(seconds.values()), 3)
    line = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
