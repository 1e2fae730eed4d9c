import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from anamnesis.llm import merkle
from tests.llm.cases import ROWS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, change=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + change
    values = (doc_id, source, lang, n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """(last node, path of (before, after) of every leaf)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for path, i in zip(paths, at, strict=True):
            run, place = runs[i // fanout], i % fanout
            path.append(("".join(run[:place]), "".join(run[place + 1 :])))
        at = [i // fanout for i in at]
        nodes = [sha("".join(run)) for run in runs]
    return (nodes[0] if nodes else None), paths


def brute(rows, fanout=2):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = (mine, *tree([leaf_of(r) for r in mine], fanout))
    root, tops = tree([trees[lang][1] for lang in langs], fanout)
    out = Counter()
    for lang, top in zip(langs, tops, strict=True):
        mine, subroot, paths = trees[lang]
        for row, path in zip(mine, paths, strict=True):
            path = path + top
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf_of(row, 1 if hit else 0)
            for before, after in path:
                node = sha(before + node + after)
            proof = sha("".join(before + after for before, after in path))
            out[(row[0], leaf_of(row), subroot, root, proof, node, node == root)] += 1
    return out


def report(docs, **options):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return Counter(tuple(r[n] for n in names) for r in merkle.merkle_report(docs, **options).collect())


def test_odd_rows(odd_docs):
    docs = odd_docs.withColumns({c: F.lit(c) for c in ("tree", "leaf", "node", "height", "changed", "path", "asked")})
    assert report(docs) == brute(ROWS)


@pytest.mark.parametrize("fanout, levels", [(2, 1), (2, 3), (3, 2)])
def test_records_of_any_shape(spark, fanout, levels):
    """Trees of 1, 2, 3, ... leaves, powers of the fanout among them; tampered rows fail, all others verify."""
    rows = [(1000 * n + i, f"text {i}", f"l{n}", "s", None if i % 5 == 0 else i) for n in (1, 2, 3, 4, 5, 8, 9, 27, 28, 65) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = report(docs, fanout=fanout, levels=levels)
    assert got == brute(rows, fanout)
    tampered = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None}
    assert {r[0] for r in got if not r[-1]} == tampered


def test_one_tree_and_one_leaf(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(5, None, None, None, None)]
    assert report(spark.createDataFrame(rows, schema)) == brute(rows)
    rows = [(i, "t", "en", None, 1) for i in range(300)] + [(7, "t", "en", None, 1)] * 40 + [(None, "t", "en", None, 1)] * 3
    assert report(spark.createDataFrame(rows, schema)) == brute(rows)


def test_empty_table(no_docs):
    assert merkle.merkle_report(no_docs).collect() == []


def test_paths_and_store(some_docs):
    """Paths lead from any leaf to the root, and a record that was tampered with is noticed."""
    leaves = merkle.document_leaves(some_docs)
    store = merkle.manifest(leaves, ["doc_id"])
    found = merkle.proofs(store, ["doc_id"])
    assert found.filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    bad = [r.withColumn("children", F.transform("children", lambda x: F.reverse(x))) for r in store.records]
    with pytest.raises(Exception, match="match its digest"):
        merkle.proofs(store._replace(records=bad), ["doc_id"]).collect()
