"""What a tiered lookup tells about each piece of evidence."""

from pyspark.sql import functions as F

from anamnesis.operators import reflect


def test_lookup_tells_staleness_sources_and_expands_facts(spark):
    up, side = [1.0, 0.0], [0.0, 1.0]
    queries = spark.createDataFrame([(1, 0, up), (2, 1, side)], "query_id bigint, bank_id bigint, embedding array<double>")
    rows = [(0, 10, "observation", up, "o"), (0, 11, "world", up, "ab" * 300), (0, 12, "experience", side, "far"), (1, 13, "world", side, "short")]
    units = spark.createDataFrame(rows, "bank_id bigint, unit_id bigint, fact_type string, embedding array<double>, text string")
    sources = spark.createDataFrame([(10, 11), (10, 12)], "obs_id bigint, source_id bigint")
    models = [(0, 20, up, "2024-01-01"), (0, 21, up, "2024-01-30"), (0, 22, up, None)]
    models = spark.createDataFrame(models, "bank_id bigint, model_id bigint, embedding array<double>, day string")
    models = models.withColumn("last_refreshed_at", F.col("day").cast("timestamp"))
    as_of = F.lit("2024-02-01").cast("timestamp")
    found = reflect.reflect_lookup(queries, units, sources, models, as_of, pieces=reflect.chunks(units))
    rows = {(r.query_id, r.tier, r.id, r.chunk_index): r for r in found.collect()}
    assert {k[2]: r.is_stale for k, r in rows.items() if k[1] == "model"} == {20: True, 21: False, 22: True}
    assert (rows[1, "observation", 10, None].freshness_status, rows[1, "observation", 10, None].source_ids) == ("unknown", [11, 12])
    assert {k[2:]: len(r.text) for k, r in rows.items() if k[1] == "expanded"} == {(11, 0): 500, (11, 1): 100, (13, 0): 5}
    assert {k for k in rows if k[1] == "fact"} == {(1, "fact", 11, None), (2, "fact", 13, None)} and len(rows) == 9
    plain = reflect.reflect_lookup(queries, units, sources, models, as_of)
    assert plain.columns == found.columns and plain.count() == 6
