import random

from pyspark.sql import functions as F

from anamnesis.operators.order import numbered
from anamnesis.plans.retain import retain

CONTENTS = "call_id bigint, bank_id bigint, text string, context string"


def test_numbers_follow_the_order(spark):
    draw = random.Random(5)
    ids = list({draw.randint(-(2**62), 2**62) for _ in range(3_000)})
    rows = spark.createDataFrame([(i, i % 3) for i in ids], "a bigint, b bigint").repartition(7)
    got = numbered(rows, ["b", "a"], "n", 40).collect()
    assert [(r.b, r.a) for r in sorted(got, key=lambda r: r.n)] == sorted((i % 3, i) for i in ids)
    assert sorted(r.n for r in got) == list(range(40, 40 + len(ids)))
    assert numbered(rows.limit(0), ["a"], "n").collect() == []


def test_call_ids_of_any_size(spark):
    last = 2**63 - 1
    contents = spark.createDataFrame([(last, 0, "Tea is hot.\nRain falls.", ""), (last - 1, 0, "Rain falls.\nSun shines.", ""), (-5, 1, "Sun shines.", "")], CONTENTS)
    as_of = F.lit("2026-01-01").cast("timestamp")
    done = retain(contents, as_of)
    assert {(r.bank_id, r.stored, r.duplicates) for r in done.counts.collect()} == {(0, 3, 1), (1, 1, 0)}
    units = done.units.orderBy("unit_id").collect()
    assert [(r.batch_id, r.text) for r in units] == [(-5, "Sun shines."), (last - 1, "Rain falls."), (last - 1, "Sun shines."), (last, "Tea is hot.")]
    more = retain(spark.createDataFrame([(7, 0, "Snow lies.", "")], CONTENTS), as_of, done.units)
    assert more.units.first().unit_id > max(r.unit_id for r in units)
