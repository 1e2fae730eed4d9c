"""The retain query, and what its search for duplicates copies and plans."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from anamnesis.catalog.all import REGISTRY, Tables
from anamnesis.functions.hooks import names_in
from anamnesis.operators import dedup, similarity


def test_retain_query_reports_every_stage(spark, tmp_path):
    turns = [
        (0, 0, "user", "Ann met Bob in Paris.\nThe tea was hot."),
        (0, 1, "user", "Ann met Bob in Paris."),
        (5, 0, "user", "Then Bob left, and bob's dog with him.\nAnn stayed with Carla."),
        (1, 0, "user", "It rains."),
    ]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.bank_id: r.asDict() for r in REGISTRY["retain"].build(Tables(spark, str(tmp_path))).collect()}
    assert got[1] == dict.fromkeys(got[1], 0) | {"bank_id": 1, "stored": 1}
    bank = got[0]
    assert (bank["stored"], bank["duplicates"]) == (4, 1)
    # Ann, Bob, Paris; Bob; Ann, Carla
    assert (bank["unit_entities"], bank["new_entities"], bank["mentions"], bank["cooccurrences"]) == (6, 4, 6, 4)
    assert bank["temporal_links"] == 4 and bank["entity_links"] == 0


def test_names(spark):
    texts = [("Ann met Jean-Luc and Émile in New York.",), ("The Reed bends; a reed does.",), ("I saw It",), (None,)]
    got = [r.who for r in spark.createDataFrame(texts, "text string").select(names_in(F.col("text")).alias("who")).collect()]
    assert got == [["Ann", "Jean-Luc", "Émile", "New", "York"], [], [], None]


def test_vectors_are_not_copied_to_cells_that_all_would_visit(spark):
    def pivots(rows):
        data = [(i, r.tolist()) for i, r in enumerate(rows)]
        return similarity._pivot_rows(spark.createDataFrame(data, "_uid bigint, _vec array<double>"), float(np.sqrt(0.2)))

    draw = np.random.default_rng(1)
    assert len(pivots(draw.normal(size=(400, 64)))) == 0
    assert len(pivots(np.eye(64)[np.arange(400) % 8] + 0.001 * draw.normal(size=(400, 64)))) == similarity.PIVOTS


def test_plan_of_covered_rows_does_not_grow_with_rounds(spark):
    def reads(n):
        pairs = spark.createDataFrame([(i, i + 1) for i in range(n)], "earlier bigint, unit_id bigint")
        found = dedup.covered(pairs)
        assert sorted(r.unit_id for r in found.collect()) == list(range(1, n + 1, 2))
        return found._jdf.queryExecution().executedPlan().toString().count("Scan")

    assert reads(3) == reads(7) == 1


def test_found_pairs_leave_a_block_bit_by_bit():
    rows = np.random.default_rng(2).normal(size=(900, 4))
    vectors = pa.array(rows.tolist(), type=pa.list_(pa.float64()))
    ids, none = pa.array(range(900), type=pa.int64()), pa.nulls(900, pa.int64())
    block = [pa.RecordBatch.from_pydict({"_uid": u, "_qid": q, "_vec": vectors, "_asks": pa.array([asks] * 900)}) for u, q, asks in ((ids, none, False), (none, ids, True))]
    schema = pa.schema([("_qid", pa.int64()), ("_uid", pa.int64()), ("similarity", pa.float64())])
    got = list(similarity._block_search(-0.5, None, True, None, schema)(iter(block)))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = (np.round(unit @ unit.T, 9) >= -0.5) & ~np.eye(900, dtype=bool)
    found = {(q.as_py(), u.as_py()) for b in got for q, u in zip(b["_qid"], b["_uid"])}
    assert len(got) > 1 and sum(b.num_rows for b in got) == want.sum() and found == set(zip(*map(np.ndarray.tolist, np.nonzero(want))))
