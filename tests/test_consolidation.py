"""Rounds of consolidation write what they change, and few queries go to the units."""

import numpy as np
from pyspark.sql import functions as F

from anamnesis.operators import similarity
from anamnesis.plans import consolidation
from tests.test_jobs import as_of, units_for_consolidation


def test_units_are_written_once_whatever_the_rounds(spark, monkeypatch):
    written = []

    def recorded(df, label):
        written.append(label)
        return materialize(df, label)

    materialize = consolidation.materialize
    monkeypatch.setattr(consolidation, "materialize", recorded)
    sources = spark.createDataFrame([], "obs_id bigint, source_id bigint")
    done = consolidation.consolidate_all(units_for_consolidation(spark), sources, as_of(), per_bank=1)
    assert written.count("units") == 2 and written.count("actions") == 4
    rows = {r.text: (r.proof_count, r.unit_id) for r in done.units.filter("fact_type = 'observation'").collect()}
    assert {k: n for k, (n, _) in rows.items()} == {"fact 1": 2, "fact 3": 2} and done.units.count() == 6
    assert {(r.obs_id, r.previous_text) for r in done.history.collect()} == {(rows["fact 1"][1], "fact 0"), (rows["fact 3"][1], "fact 2")}
    assert {r.action for r in done.actions.collect()} == {"create", "update"} and done.actions.count() == 4


def test_few_queries_find_what_a_shuffle_finds(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(None if i % 17 == 0 else i % 3, i, None if i % 13 == 0 else draw.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]
    units = spark.createDataFrame(rows, "bank_id int, unit_id bigint, embedding array<double>").repartition(5)
    asked = units.filter("unit_id % 5 = 0").select("bank_id", F.col("unit_id").cast("string").alias("query_id"), "embedding")
    want = sorted(map(tuple, similarity.nearest(asked, units, 0.3, 4).collect()))
    few = similarity.nearest_few(asked, units, 0.3, 4)
    assert sorted(map(tuple, few.collect())) == want and "FlatMapGroupsInArrow" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(similarity, "FEW_QUERIES", 10)
    assert sorted(map(tuple, similarity.nearest_few(asked, units, 0.3, 4).collect())) == want
