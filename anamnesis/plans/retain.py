"""From conversation texts to stored, deduplicated and linked memory units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.functions import hooks
from anamnesis.functions.facts import validate_facts
from anamnesis.functions.text import embedding_text
from anamnesis.operators import dedup, entities, links
from anamnesis.operators.order import numbered
from anamnesis.session import materialize


@dataclass(frozen=True)
class Retained:
    """What one batch of retain calls adds: units, their entities, entities not known before, links of all kinds,
    co-occurrence counts, mentions of entities by call, and (bank_id, stored, duplicates)."""

    units: DataFrame
    unit_entities: DataFrame
    new_entities: DataFrame
    links: DataFrame
    cooccurrences: DataFrame
    mentions: DataFrame
    counts: DataFrame


def facts_of(contents: DataFrame, as_of: Column, extractor=None, embedder=hooks.hashed_words, first: int = 0) -> DataFrame:
    """Valid facts with ids from ``first`` on in arrival order (call, place in the call), and their embeddings."""
    raw = hooks.sentence_facts(contents) if extractor is None else hooks.extract_facts(contents, extractor)
    facts = numbered(validate_facts(raw), ["call_id", "pos", "bank_id", "text"], "unit_id", first).select(
        "unit_id",
        "bank_id",
        F.col("call_id").alias("batch_id"),
        "text",
        F.nullif("context", F.lit("")).alias("context"),
        "fact_type",
        "fact_kind",
        "who",
        "event_date",
        "occurred_start",
        "occurred_end",
        as_of.alias("mentioned_at"),
        as_of.alias("created_at"),
        embedding_text(F.col("text"), F.col("event_date")).alias("_embed"),
    )
    return hooks.with_embeddings(facts, "_embed", embedder).drop("_embed")


def retain(
    contents: DataFrame,
    as_of: Column,
    stored_units: DataFrame | None = None,
    known_entities: DataFrame | None = None,
    company: DataFrame | None = None,
    extractor=None,
    embedder=hooks.hashed_words,
    threshold: float = dedup.THRESHOLD,
    stored_entities: DataFrame | None = None,
    link_threshold: float = links.SEMANTIC_THRESHOLD,
) -> Retained:
    """Extract, embed, drop near-duplicates, resolve the names of each call, link and count.

    ``stored_units``, ``stored_entities`` (their bridge) and ``known_entities`` are what earlier batches left.
    ``mentions(entity_id, batch_id, at)`` updates the entities by ``entities.entity_mentions``, the co-occurrences are
    added to stored ones by ``entities.merge_cooccurrence``.
    """
    old = stored_units
    # units are numbered on from the stored ones
    last = None if old is None else old.agg(F.max("unit_id")).first()[0]
    facts = materialize(facts_of(contents, as_of, extractor, embedder, 0 if last is None else last + 1), "facts")
    kept = materialize(dedup.keep_new(facts, old, threshold), "kept")
    done = facts.groupBy("bank_id").agg(F.count("*").alias("facts"))
    left = kept.groupBy("bank_id").agg(F.count("*").alias("stored"))
    counts = done.join(left, "bank_id", "left").na.fill(0, ["stored"])
    counts = counts.withColumn("duplicates", F.col("facts") - F.col("stored")).drop("facts")
    spark = contents.sparkSession
    if known_entities is None:
        known_entities = spark.createDataFrame([], "bank_id bigint, entity_id bigint, canonical_name string, last_seen timestamp")
    if company is None:
        company = spark.createDataFrame([], "entity_id bigint, company string")
    mentions = kept.select(F.col("unit_id").alias("call_id"), "bank_id", F.explode("who").alias("name"), "event_date")
    resolved = entities.resolve_entities(mentions, known_entities, company)
    bridge = materialize(resolved.select(F.col("call_id").alias("unit_id"), "entity_id").distinct(), "bridge")
    old_units = kept.limit(0) if old is None else old.select(kept.columns)
    old_bridge = bridge.limit(0) if stored_entities is None else stored_entities.select("unit_id", "entity_id")
    edges = link(kept, bridge.unionByName(old_bridge), old_units, link_threshold)
    named = bridge.join(kept.select("bank_id", "batch_id", "unit_id", F.col("mentioned_at").alias("at")), "unit_id")
    return Retained(
        kept,
        bridge,
        entities.create_entities(resolved, as_of),
        edges,
        entities.cooccurrence(named),
        named.select("entity_id", "batch_id", "at").distinct(),
        counts,
    )


def link(retained: DataFrame, unit_entities: DataFrame, stored: DataFrame, threshold: float = links.SEMANTIC_THRESHOLD) -> DataFrame:
    """Links of freshly stored units to the stored ones and to their own call."""
    return links.build_links(retained, unit_entities, stored, threshold)


def added(done: Retained) -> DataFrame:
    """(bank_id, stored, duplicates and rows of every other table that a batch adds), one row a bank."""
    banks = done.units.select("unit_id", "bank_id")
    named = done.new_entities.select("entity_id", "bank_id")
    kinds = done.links.groupBy("bank_id").agg(*[F.count_if(F.col("link_type") == kind).alias(f"{kind}_links") for kind in links.KINDS])
    rows = {
        "unit_entities": done.unit_entities.join(banks, "unit_id"),
        "new_entities": named,
        "cooccurrences": done.cooccurrences,
        "mentions": done.mentions.join(done.unit_entities.join(banks, "unit_id").select("entity_id", "bank_id").distinct(), "entity_id"),
    }
    counts = done.counts.join(kinds, "bank_id", "left")
    for name, table in rows.items():
        counts = counts.join(table.groupBy("bank_id").agg(F.count("*").alias(name)), "bank_id", "left")
    return counts.na.fill(0, [*[f"{kind}_links" for kind in links.KINDS], *rows])
