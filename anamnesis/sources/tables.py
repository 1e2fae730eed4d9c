"""Schemas of the memory tables and keyed maintenance of stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG, _TEXT, _TIME, _INT = T.LongType(), T.StringType(), T.TimestampType(), T.IntegerType()
_TEXTS, _VECTOR = T.ArrayType(_TEXT), T.ArrayType(T.FloatType())


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


HISTORY = _table(previous_text=_TEXT, changed_at=_TIME, reason=_TEXT, source_memory_id=_LONG)
SCHEMAS = {
    "banks": _table(
        bank_id=_LONG, name=_TEXT, mission=_TEXT, background=_TEXT,
        disposition=_table(skepticism=_INT, literalism=_INT, empathy=_INT), directives=_TEXTS,
        metadata=T.MapType(_TEXT, _TEXT), created_at=_TIME, updated_at=_TIME,
    ),
    "units": _table(
        bank_id=_LONG, unit_id=_LONG, batch_id=_LONG, text=_TEXT, context=_TEXT, embedding=_VECTOR, fact_type=_TEXT,
        fact_kind=_TEXT, what=_TEXT, who=_TEXTS, when_description=_TEXT, where_description=_TEXT, why_description=_TEXT,
        event_date=_TIME, occurred_start=_TIME, occurred_end=_TIME, mentioned_at=_TIME, proof_count=_LONG,
        history=T.ArrayType(HISTORY), confidence_score=T.DoubleType(), consolidated_at=_TIME, tags=_TEXTS,
        created_at=_TIME, updated_at=_TIME, freshness_status=_TEXT,
    ),
    "entities": _table(
        bank_id=_LONG, entity_id=_LONG, canonical_name=_TEXT, entity_type=_TEXT, first_seen=_TIME, last_seen=_TIME,
        mention_count=_LONG,
    ),
    "unit_entities": _table(unit_id=_LONG, entity_id=_LONG),
    "links": _table(
        bank_id=_LONG, from_unit_id=_LONG, to_unit_id=_LONG, link_type=_TEXT, weight=T.DoubleType(), entity_id=_LONG
    ),
    "cooccurrences": _table(
        bank_id=_LONG, entity_id_1=_LONG, entity_id_2=_LONG, cooccurrence_count=_LONG, last_cooccurred=_TIME
    ),
    "models": _table(
        bank_id=_LONG, model_id=_LONG, entity_id=_LONG, name=_TEXT, description=_TEXT, content=_TEXT, source_query=_TEXT,
        embedding=_VECTOR, tags=_TEXTS, max_tokens=_INT, refresh_after_consolidation=T.BooleanType(),
        last_refreshed_at=_TIME, created_at=_TIME, updated_at=_TIME,
    ),
    "obs_sources": _table(obs_id=_LONG, source_id=_LONG),
    "chunks": _table(bank_id=_LONG, unit_id=_LONG, chunk_index=_INT, text=_TEXT),
}
# tables that go with their bank, and with their unit
BANK_CHILDREN = ["units", "entities", "links", "cooccurrences", "models", "chunks"]
UNIT_CHILDREN = {"unit_entities": ["unit_id"], "links": ["from_unit_id", "to_unit_id"], "chunks": ["unit_id"], "obs_sources": ["obs_id"]}


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One stored table with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def store(df: DataFrame, path: str, name: str, mode: str = "append") -> None:
    """Write a table clustered by bank, so that bank filters prune files."""
    writer = df.repartitionByRange("bank_id") if "bank_id" in df.columns else df
    writer.write.mode(mode).parquet(f"{path}/{name}")


def load_jdbc(spark: SparkSession, url: str, name: str, partitions: int, banks: tuple[int, int], **options: str) -> DataFrame:
    """One table of a database, read in ranges of bank_id; ``banks`` are the least and the largest one."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    ranged = {"partitionColumn": "bank_id", "lowerBound": str(banks[0]), "upperBound": str(banks[1]), "numPartitions": str(partitions)}
    return reader.options(**ranged).load()


def upsert_latest(stored: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Whole-row replacement by key; the change with the highest ``order`` wins."""
    fields = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.struct(*fields).alias("_row"), F.lit(None).cast("bigint").alias("_at"))
    new = changes.select(*keys, F.struct(*fields).alias("_row"), F.col(order).cast("bigint").alias("_at"))
    both = old.unionByName(new).withColumn("_at", F.coalesce("_at", F.lit(-(2**62))))
    return both.groupBy(*keys).agg(F.max_by("_row", "_at").alias("_row")).select(*keys, "_row.*")


def insert_missing(stored: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet, once each."""
    return rows.dropDuplicates(list(keys)).join(stored, list(keys), "left_anti")


def delete_rows(stored: DataFrame, deleted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.join(deleted, list(keys), "left_anti")


def delete_banks(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """All tables without the deleted banks and what hangs on their units."""
    banks = deleted.select("bank_id")
    units = tables["units"].join(banks, "bank_id", "left_semi").select("unit_id")
    left = {}
    for name, df in tables.items():
        if "bank_id" in df.columns:
            df = df.join(banks, "bank_id", "left_anti")
        else:
            for column in UNIT_CHILDREN.get(name, []):
                df = df.join(units.withColumnRenamed("unit_id", column), column, "left_anti")
        left[name] = df
    return left
