"""Evidence lookups: expanded units, tiered search, validation of cited ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.operators import search
from anamnesis.session import materialize

# Fixed values of the lookups.
IDS_PER_REQUEST = 10
CHUNKS_PER_REQUEST = 100
MAX_ITERATIONS = 10
CHUNK_CHARS = 500


def chunks(units: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """(bank_id, unit_id, chunk_index, text): the whole text in pieces of ``size`` characters."""
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s)(.{{1,{size}}})"), F.lit(1))
    return units.select("bank_id", "unit_id", F.posexplode(pieces).alias("chunk_index", "text"))


def expand_units(requests: DataFrame, units: DataFrame, pieces: DataFrame) -> DataFrame:
    """Requested units of the own bank with their chunks, long form.

    ``requests(query_id, bank_id, unit_id, pos)``, each of one bank: the first
    ten ids of a request count, and its first hundred chunks by (unit, index).
    How many chunks of which unit these are follows from the chunk numbers
    alone; the texts join the requests last and are never sorted by request.
    """
    asked = requests.filter(F.col("pos") < IDS_PER_REQUEST)
    found = asked.join(units.select("bank_id", "unit_id", "fact_type"), ["bank_id", "unit_id"])
    sizes = pieces.groupBy("bank_id", "unit_id").agg(F.count("*").alias("_size"))
    # an id that is asked for twice brings every chunk twice
    keys = ["query_id", "bank_id", "unit_id"]
    held = asked.join(sizes, ["bank_id", "unit_id"]).groupBy(*keys).agg(F.count("*").alias("_copies"), F.first("_size").alias("_size"))
    # at most IDS_PER_REQUEST ids a request
    before = Window.partitionBy("query_id").orderBy("unit_id", "bank_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(CHUNKS_PER_REQUEST) - F.coalesce(F.sum(F.col("_size") * F.col("_copies")).over(before), F.lit(0))
    shares = held.select("query_id", F.col("bank_id").alias("_bank"), "unit_id", "_copies", left.alias("_left"))
    wanted = found.select(*keys, "fact_type").join(shares.filter("_left > 0"), ["query_id", "unit_id"], "left")
    nth = F.row_number().over(Window.partitionBy("_bank", "_unit").orderBy("chunk_index", "text"))
    placed = pieces.select(F.col("bank_id").alias("_bank"), F.col("unit_id").alias("_unit"), "chunk_index", "text").withColumn("_nth", nth)
    wanted = wanted.withColumnRenamed("_bank", "_of")
    earlier = (F.col("_nth") - 1) * F.col("_copies")
    met = wanted.join(placed, (F.col("_of") == F.col("_bank")) & (F.col("unit_id") == F.col("_unit")) & (earlier < F.col("_left")), "left")
    times = F.coalesce(F.least("_copies", F.col("_left") - earlier), F.lit(1)).cast("int")
    rows = met.withColumn("_time", F.explode(F.sequence(F.lit(1), times)))
    return rows.select(*keys, "fact_type", "chunk_index", "text")


def validate_evidence(cited: DataFrame, available: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cited ids that were really found, and a verdict per answer.

    ``cited`` and ``available`` are (query_id, tier, id); ``answers`` is
    (query_id, iteration).  An answer that cites nothing while nothing was found
    is rejected unless it comes from the last iteration.
    """
    keys = ["query_id", "tier", "id"]
    valid = cited.join(available.select(*keys).distinct(), keys, "left_semi")
    n_cited = cited.groupBy("query_id").agg(F.count("*").alias("cited"))
    n_valid = valid.groupBy("query_id").agg(F.count("*").alias("valid"))
    n_found = available.groupBy("query_id").agg(F.count("*").alias("found"))
    counts = answers
    for part in (n_cited, n_valid, n_found):
        counts = counts.join(part, "query_id", "left")
    counts = counts.na.fill(0, ["cited", "valid", "found"])
    rejected = (F.col("cited") == 0) & (F.col("found") == 0) & (F.col("iteration") < MAX_ITERATIONS - 1)
    verdict = counts.select("query_id", (F.col("cited") - F.col("valid")).alias("removed"), rejected.alias("rejected"))
    return valid, verdict


def reflect_lookup(
    queries: DataFrame,
    units: DataFrame,
    sources: DataFrame,
    models: DataFrame,
    as_of: Column,
    wanted: Sequence[str] | None = None,
    mode: str = "any",
    exclude_models: DataFrame | None = None,
    pieces: DataFrame | None = None,
) -> DataFrame:
    """(query_id, tier, id, similarity, is_stale, freshness_status, source_ids, chunk_index, text): summaries with
    their staleness, then observations with their freshness and first sources, then raw facts, all under the same
    tags; with ``pieces``, the chunks of the facts found first come last, in the tier 'expanded'.

    ``exclude_models(model_id)`` are summaries not to use, such as the one being refreshed.  Without a model that
    chooses what to expand, these are the best IDS_PER_REQUEST facts of a query.
    """
    from_models = search.search_models(queries, models, as_of, exclude_models, wanted, mode)
    from_observations = search.search_observations(queries, units, sources, wanted, mode)
    from_facts = search.search_facts(queries, units, wanted, mode)
    expanded = None
    if pieces is not None:
        from_facts = materialize(from_facts, "reflect-facts")
        best = from_facts.filter(F.col("rn") <= IDS_PER_REQUEST).withColumn("pos", F.col("rn") - 1)
        requests = best.join(queries.select("query_id", "bank_id"), "query_id").select("query_id", "bank_id", "unit_id", "pos")
        expanded = expand_units(requests, units, pieces)

    def tier(name: str, rows: DataFrame, ident: str, *more: str) -> DataFrame:
        return rows.select("query_id", F.lit(name).alias("tier"), F.col(ident).alias("id"), *more)

    found = (
        tier("model", from_models, "model_id", "similarity", "is_stale")
        .unionByName(tier("observation", from_observations, "unit_id", "similarity", "freshness_status", "source_ids"), True)
        .unionByName(tier("fact", from_facts, "unit_id", "similarity"), True)
    )
    if expanded is None:
        return found.withColumns({"chunk_index": F.lit(None).cast("int"), "text": F.lit(None).cast("string")})
    return found.unionByName(tier("expanded", expanded, "unit_id", "chunk_index", "text"), True)
