"""Vector and keyword search over memory units, for any number of queries at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.functions import tags as tag_rules
from anamnesis.functions.dates import is_stale
from anamnesis.operators import keywords
from anamnesis.operators.order import top
from anamnesis.operators.similarity import nearest, nearest_few

# Fixed values of the searches.
SEARCH_THRESHOLD = 0.1
PER_TYPE_LIMIT = 34
FACT_TYPES = ["world", "experience", "observation"]
OBSERVATIONS_DEFAULT, OBSERVATIONS_CAP = 20, 50
FACTS_DEFAULT, FACTS_CAP = 30, 100
MODELS_DEFAULT, MODELS_CAP = 5, 20
SOURCES_SHOWN = 5
RELATED_THRESHOLD, RELATED_LIMIT = 0.3, 10
MEMORY_THRESHOLD, MEMORY_LIMIT = 0.7, 5
MATRIX_SHOWN = 30
# blocks of queries of a search whose rows all have one key
SCOPE_BLOCKS = 16


def semantic_search(
    queries: DataFrame, units: DataFrame, threshold: float = SEARCH_THRESHOLD, per_type: int = PER_TYPE_LIMIT
) -> DataFrame:
    """(query_id, unit_id, fact_type, similarity): the best units of each fact type."""
    known = units.filter(F.col("fact_type").isin(FACT_TYPES))
    return nearest(queries, known, threshold, per_type, per="fact_type").drop("rn")


def _visible(units: DataFrame, wanted: Sequence[str] | None, mode: str) -> DataFrame:
    if not wanted:
        return units
    return units.filter(tag_rules.visible(F.col("tags"), F.array(*[F.lit(w) for w in wanted]), mode))


def first_sources(sources: DataFrame, n: int = SOURCES_SHOWN) -> DataFrame:
    """(obs_id, source_ids): the first n source ids of each observation."""
    kept = top(sources, ["obs_id"], [F.asc("source_id")], n)
    return kept.groupBy("obs_id").agg(F.array_sort(F.collect_list("source_id")).alias("source_ids"))


def search_observations(
    queries: DataFrame,
    units: DataFrame,
    sources: DataFrame,
    wanted: Sequence[str] | None = None,
    mode: str = "any",
    limit: int = OBSERVATIONS_DEFAULT,
) -> DataFrame:
    """Observations with their first source ids and freshness ('unknown' if unset)."""
    seen = _visible(units.filter(F.col("fact_type") == "observation"), wanted, mode)
    found = nearest(queries, seen, SEARCH_THRESHOLD, min(limit, OBSERVATIONS_CAP))
    status = F.col("freshness_status") if "freshness_status" in units.columns else F.lit(None).cast("string")
    details = seen.select("unit_id", F.coalesce(status, F.lit("unknown")).alias("freshness_status"))
    return (
        found.join(details, "unit_id")
        .join(first_sources(sources).withColumnRenamed("obs_id", "unit_id"), "unit_id", "left")
        .withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<bigint>")))
    )


def search_facts(
    queries: DataFrame,
    units: DataFrame,
    wanted: Sequence[str] | None = None,
    mode: str = "any",
    limit: int = FACTS_DEFAULT,
) -> DataFrame:
    """Raw facts only; observations are left out."""
    facts = units.filter(F.col("fact_type").isin("world", "experience"))
    return nearest(queries, _visible(facts, wanted, mode), SEARCH_THRESHOLD, min(limit, FACTS_CAP))


def search_models(
    queries: DataFrame,
    models: DataFrame,
    as_of: Column,
    exclude: DataFrame | None = None,
    wanted: Sequence[str] | None = None,
    mode: str = "any",
    limit: int = MODELS_DEFAULT,
) -> DataFrame:
    """Summaries with a staleness flag; ``exclude`` is a table of model ids to skip."""
    seen = _visible(models, wanted, mode)
    if exclude is not None:
        seen = seen.join(exclude, "model_id", "left_anti")
    found = nearest(queries, seen, SEARCH_THRESHOLD, min(limit, MODELS_CAP), unit_id="model_id")
    details = models.select("model_id", is_stale(F.col("last_refreshed_at"), as_of).alias("is_stale"))
    return found.join(details, "model_id")


def related_observations(
    facts: DataFrame,
    units: DataFrame,
    sources: DataFrame,
    threshold: float = RELATED_THRESHOLD,
    limit: int = RELATED_LIMIT,
    stored: bool = False,
) -> DataFrame:
    """(query_id, unit_id, similarity, rn): observations a fact may belong to.

    Where the facts are ``stored``, a few of them go to the observations instead of meeting them in a shuffle.
    """
    find = nearest_few if stored else nearest
    return find(facts, units.filter(F.col("fact_type") == "observation"), threshold, limit)


def source_memories(related: DataFrame, units: DataFrame, sources: DataFrame) -> DataFrame:
    """(obs_id, source_id, pos): the shown sources of the observations, oldest first."""
    wanted = related.select(F.col("unit_id").alias("obs_id")).distinct()
    ids = first_sources(sources).join(wanted, "obs_id", "left_semi").select("obs_id", F.explode("source_ids").alias("source_id"))
    details = units.select(F.col("unit_id").alias("source_id"), "text", "created_at", "event_date", "occurred_start")
    # at most SOURCES_SHOWN rows an observation
    age = Window.partitionBy("obs_id").orderBy("created_at", "source_id")
    return ids.join(details, "source_id").withColumn("pos", F.row_number().over(age))


def everything(df: DataFrame) -> DataFrame:
    """Put all rows under one search key.

    The key is computed from the row: a literal would be folded away and turn
    the equi join on it into a nested loop.
    """
    return df.withColumn("scope", F.pmod(F.xxhash64("embedding"), F.lit(1)))


def memory_search(
    queries: DataFrame, records: DataFrame, threshold: float = MEMORY_THRESHOLD, limit: int = MEMORY_LIMIT
) -> DataFrame:
    """The most similar stored messages, whatever their role or session."""
    return nearest(everything(queries), everything(records), threshold, limit, ["scope"], unit_id="record_id", query_blocks=SCOPE_BLOCKS)


def similarity_matrix(units: DataFrame, shown: int = MATRIX_SHOWN) -> DataFrame:
    """The ``shown`` closest other rows of each row of the similarity matrix."""
    rows = everything(units)
    return nearest(
        rows.withColumnRenamed("unit_id", "query_id"), rows, -1.0, shown, ["scope"], exclude_self=True, query_blocks=SCOPE_BLOCKS
    )


def pca_2d(units: DataFrame) -> DataFrame:
    """(unit_id, x, y, x_share, y_share): centred first two principal components."""
    vectors = units.filter(F.col("embedding").isNotNull()).select(
        "unit_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v")
    )
    model = PCA(k=2, inputCol="v", outputCol="p").fit(vectors)
    placed = model.transform(vectors).select("unit_id", vector_to_array("p").alias("p"))
    x, y = F.col("p")[0], F.col("p")[1]
    shares = [float(v) for v in model.explainedVariance.toArray()]
    return placed.select(
        "unit_id",
        (x - placed.agg(F.avg(x)).scalar()).alias("x"),
        (y - placed.agg(F.avg(y)).scalar()).alias("y"),
        F.lit(shares[0]).alias("x_share"),
        F.lit(shares[1]).alias("y_share"),
    )


def keyword_search(
    queries: DataFrame, units: DataFrame | keywords.KeywordIndex, per_type: int = PER_TYPE_LIMIT, rows_per_block: int = keywords.LIST_UNITS
) -> DataFrame:
    """(query_id, unit_id, fact_type, score): units that contain a keyword of the query.

    The score is the best bigram similarity between any keyword and the unit's
    text or context.  Give a stored index instead of the units to search them
    more than once.
    """
    if isinstance(units, DataFrame):
        units = keywords.build_index(units.filter(F.col("fact_type").isin(FACT_TYPES)), rows_per_block)
    return keywords.keyword_search(queries, units, per_type)
