"""Freshness of observations from the dates of their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.functions.dates import days_between

# Fixed values of the freshness rule.
RECENT_DAYS = 30
RISING, FALLING = 1.5, 0.5


def status(recent: Column, older: Column, earliest: Column, as_of: Column, days: int = RECENT_DAYS) -> Column:
    """Status of evidence counts before and after the cutoff."""
    span = F.greatest(days_between(as_of, earliest), F.lit(1.0))
    recent_rate = recent / days
    older_rate = older / F.greatest(span - days, F.lit(1.0))
    ratio = recent_rate / older_rate
    return (
        F.when(F.coalesce(recent, F.lit(0)) == 0, "stale")
        .when(older == 0, "new")
        .when(ratio > RISING, "strengthening")
        .when(ratio < FALLING, "weakening")
        .otherwise("stable")
    )


def freshness(observations: DataFrame, sources: DataFrame, units: DataFrame, as_of: Column, days: int = RECENT_DAYS) -> DataFrame:
    """(bank_id, obs_id, freshness_status); sources that no longer exist do not count."""
    recent = F.col("created_at") > as_of - F.expr(f"interval {days} days")
    evidence = (
        sources.join(units.select(F.col("unit_id").alias("source_id"), "bank_id", "created_at"), "source_id")
        .groupBy("bank_id", "obs_id")
        .agg(
            F.count_if(recent).alias("recent"), F.count_if(~recent).alias("older"), F.min("created_at").alias("earliest")
        )
    )
    rows = observations.select("bank_id", F.col("unit_id").alias("obs_id")).join(evidence, ["bank_id", "obs_id"], "left")
    return rows.select(
        "bank_id",
        "obs_id",
        status(F.col("recent"), F.col("older"), F.col("earliest"), as_of, days).alias("freshness_status"),
    )


def freshness_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("bank_id", "freshness_status").agg(F.count("*").alias("observations"))
