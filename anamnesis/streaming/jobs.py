"""Retain and consolidation as streaming jobs.

A micro-batch writes each of its tables below its own number and then a commit
that names them; ``committed`` reads only what a commit names.  A job that was
killed writes the folders of its last micro-batch again, and a micro-batch that
has its commit isn't run again, so a restarted job stores nothing twice and a
reader never sees some tables of a micro-batch without the others.

Defined cases: a micro-batch without rows commits empty tables or none; a job
that has committed nothing has no state (``retained`` gives no tables,
``consolidated`` the tables it was given).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from anamnesis.functions import hooks
from anamnesis.operators import consolidate, dedup, entities
from anamnesis.plans.consolidation import consolidate_all
from anamnesis.plans.retain import retain
from anamnesis.session import materialize

# The consolidation interval and its lower bound.
INTERVAL_SECONDS, MIN_INTERVAL_SECONDS = 300, 10
FACTS = ("world", "experience")


def interval(seconds: int = INTERVAL_SECONDS) -> str:
    return f"{max(MIN_INTERVAL_SECONDS, seconds)} seconds"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def is_committed(spark: SparkSession, path: str, number: int) -> bool:
    return _exists(spark, f"{path}/commits/batch={number}/_SUCCESS")


def commit(spark: SparkSession, tables: dict[str, DataFrame], path: str, number: int) -> None:
    """Write the tables of a micro-batch, and its commit after them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
    names = spark.createDataFrame([(name,) for name in tables], "name string")
    names.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={number}")


def committed(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The rows of one table that commits name, with the number of their ``batch``; None where there are none."""
    if not (_exists(spark, f"{path}/commits") and _exists(spark, f"{path}/{name}")):
        return None
    named = spark.read.parquet(f"{path}/commits").filter(F.col("name") == name).select("batch")
    return spark.read.parquet(f"{path}/{name}").join(named, "batch", "left_semi")


def retained(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What a retain job has stored: units, unit_entities, links, counts, and entities and co-occurrences added up."""
    names = ("units", "unit_entities", "entities", "links", "cooccurrences", "mentions", "counts")
    stored = {name: df for name in names if (df := committed(spark, path, name)) is not None}
    if not stored:
        return {}
    fields = [c for c in stored["entities"].columns if c not in ("batch", "entity_id")]
    first = stored["entities"].groupBy("entity_id").agg(F.min_by(F.struct(*fields), "batch").alias("row"), F.min("batch").alias("made"))
    # the mentions of its first batch are counted in the row of a new entity
    again = stored["mentions"].join(first.select("entity_id", "made"), "entity_id", "left").filter("made IS NULL OR batch > made")
    known = entities.entity_mentions(first.select("entity_id", "row.*"), again.drop("made", "batch"))
    empty = stored["cooccurrences"].drop("batch")
    tables = {name: df.drop("batch") for name, df in stored.items() if name != "mentions"}
    return tables | {"entities": known, "cooccurrences": entities.merge_cooccurrence(empty, empty.limit(0))}


def retain_stream(
    contents: DataFrame,
    path: str,
    as_of: Column,
    extractor=None,
    embedder=hooks.hashed_words,
    threshold: float = dedup.THRESHOLD,
    once: bool = False,
) -> StreamingQuery:
    """Retain each micro-batch of (call_id, bank_id, text, context): units, entities, links and counts.

    A micro-batch sees the units, entities and co-occurrences of those before it.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if is_committed(spark, path, number):
            return
        old = retained(spark, path)
        company = entities.cooc_names(old["cooccurrences"], old["entities"]) if old else None
        known = old["entities"].select("bank_id", "entity_id", "canonical_name", "last_seen") if old else None
        done = retain(
            batch,
            as_of,
            old.get("units"),
            known,
            company,
            extractor=extractor,
            embedder=embedder,
            threshold=threshold,
            stored_entities=old.get("unit_entities"),
        )
        tables = {
            "units": done.units,
            "unit_entities": done.unit_entities,
            "entities": done.new_entities,
            "links": done.links,
            "cooccurrences": done.cooccurrences,
            "mentions": done.mentions,
            "counts": done.counts,
        }
        commit(spark, tables, path, number)

    writer = contents.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval())).start()


def consolidated(spark: SparkSession, path: str, units: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``units`` and ``sources`` after all that a consolidation job has committed."""
    if "consolidated_at" not in units.columns:
        units = units.withColumn("consolidated_at", F.lit(None).cast("timestamp"))
    observations, done, made = (committed(spark, path, name) for name in ("observations", "done", "sources"))
    if observations is None:
        return units, sources
    fields = [c for c in observations.columns if c not in ("batch", "unit_id")]
    latest = observations.groupBy("unit_id").agg(F.max_by(F.struct(*fields), "batch").alias("row")).select("unit_id", "row.*")
    stamps = done.groupBy("unit_id").agg(F.min("consolidated_at").alias("stamp"))
    kept = units.join(latest.select("unit_id"), "unit_id", "left_anti").join(stamps, "unit_id", "left")
    kept = kept.withColumn("consolidated_at", F.coalesce("consolidated_at", "stamp")).drop("stamp")
    return kept.unionByName(latest, True), sources.unionByName(made.select(sources.columns)).distinct()


def consolidate_stream(
    fresh_units: DataFrame,
    path: str,
    units: DataFrame,
    sources: DataFrame,
    as_of: Column,
    decide: consolidate.Decider = consolidate.nearest_decides,
    unit_entities: DataFrame | None = None,
    embedder: hooks.Embedder = hooks.hashed_words,
    per_bank: int = consolidate.FACTS_PER_ROUND,
    once: bool = False,
) -> StreamingQuery:
    """Fold all open facts of the banks of each micro-batch into observations.

    Created and changed observations, their sources, history and gained entities, and the facts that are done are
    stored; ``consolidated`` applies them.  Facts whose decision failed stay open for the next micro-batch of their bank.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if is_committed(spark, path, number):
            return
        every, known = consolidated(spark, path, units, sources)
        highest = every.agg(F.max("unit_id")).first()[0]
        due = materialize(every.join(batch.select("bank_id").distinct(), "bank_id", "left_semi"), "due-units")
        cited = materialize(known.join(due.select(F.col("unit_id").alias("obs_id")), "obs_id", "left_semi"), "due-sources")
        gained = committed(spark, path, "entities")
        bridge = unit_entities
        if gained is not None:
            gained = gained.drop("batch")
            bridge = gained if bridge is None else bridge.select(gained.columns).unionByName(gained)
        done = consolidate_all(due, cited, as_of, decide, per_bank, bridge, embedder, highest)
        if done.actions is None:
            return commit(spark, {}, path, number)
        updated = done.actions.filter(F.col("action") == "update").select(F.col("learning_id").alias("unit_id"))
        created = done.units.join(due.select("unit_id"), "unit_id", "left_anti").select("unit_id")
        touched = updated.unionByName(created).distinct()
        open_facts = due.filter(F.col("consolidated_at").isNull() & F.col("fact_type").isin(*FACTS)).select("unit_id")
        closed = done.units.filter(F.col("consolidated_at").isNotNull()).join(open_facts, "unit_id", "left_semi")
        tables = {
            "observations": done.units.join(touched, "unit_id", "left_semi"),
            "done": closed.select("unit_id", "consolidated_at"),
            "sources": done.sources.join(cited, ["obs_id", "source_id"], "left_anti"),
            "actions": done.actions,
            "entities": done.entities,
            "history": done.history,
        }
        commit(spark, tables, path, number)

    writer = fresh_units.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval())).start()
