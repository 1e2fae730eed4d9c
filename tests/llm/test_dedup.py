import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.llm import embedding_dedup, exact_dedup, line_dedup, mixing, near_dedup
from anamnesis.llm.components import components
from tests.llm.brute import LOWER, WORD, find, near
from tests.llm.cases import ROWS


def test_exact_groups(odd_docs):
    rows = exact_dedup.exact_groups(odd_docs).collect()
    assert len(rows) == len(ROWS)
    groups = {}
    for doc_id, text, *_ in ROWS:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        keep = max(ids, key=lambda i: -1 if i is None else i)
        want.update((i, keep, len(ids), digest) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact_stage_keeps_all_columns(odd_docs):
    kept = exact_dedup.drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    assert sorted(texts) == sorted({(t or "").translate(LOWER) for _, t, *_ in ROWS})


def test_exact_groups_without_heavy_digests_are_the_same(odd_docs):
    few = exact_dedup.exact_groups(odd_docs, heavy=1, tracked=16)
    assert Counter(few.collect()) == Counter(exact_dedup.exact_groups(odd_docs).collect())


def test_near_report(odd_docs):
    rows = near_dedup.near_report(odd_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), words=2).collect()
    want = near([(i, t) for i, t, *_ in ROWS if i is not None], 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_report_takes_odd_rows(odd_docs):
    rows = near_dedup.near_report(odd_docs, words=2).collect()
    assert len(rows) == len(ROWS)
    kept = near_dedup.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect())[3] == 0 and Counter(r.doc_id for r in kept.collect())[None] == 1


def test_near_links_of_a_star(spark):
    """Copies that resemble the original but not each other are all found."""
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 41):
        words = list(base)
        for j in range(4):
            words[(i * 7 + j * 23) % 98 + 1] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_report(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near(rows, 2, 80)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def _copied(rows):
    """{doc_id: (removed lines, longest run)} by looking at all earlier places."""
    lines = {i: [x for x in (t or "").split("\n") if x.strip(" ")] for i, t in rows}
    gone, longest = Counter(), Counter()
    for i in sorted(lines):
        taken = set()
        for p in range(len(lines[i])):
            for j in [j for j in sorted(lines) if j <= i]:
                for q in range(len(lines[j]) if j < i else p):
                    n = 0
                    while p + n < len(lines[i]) and q + n < len(lines[j]) and lines[i][p + n] == lines[j][q + n]:
                        n += 1
                    if n >= 2 or n == 1 and len(WORD.findall(lines[i][p])) >= 50:
                        longest[i] = max(longest[i], n)
                        taken.update(range(p, p + n))
        gone[i] = len(taken)
    return {i: (len(lines[i]), gone[i], longest[i]) for i in lines}


def test_line_runs(spark):
    filler = " ".join(f"v{i}" for i in range(55))
    rows = [
        (1, "a\nb\nc\nd\ne\nf"),
        (2, "x\nb\nc\nd\ny"),
        (3, f"{filler}\nq"),
        (4, f"q\n{filler}"),
        (5, "a\nb\n\nc\nd\ne\nf\nz"),
        (6, "s\ns\ns\ns"),
        (7, "alone\nb\nonly"),
        (8, None),
    ]
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string"), runs=True).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.longest_run) for r in got} == _copied(rows)
    text = {r.doc_id: r.text for r in got}
    assert (text[2], text[4], text[5], text[8]) == ("x\ny", "q", "\nz", None)


def test_full_sieve_changes_no_line(spark, monkeypatch):
    draw = np.random.default_rng(11)
    rows = [(n, "\n".join(f"line {k}" for k in draw.integers(0, 40, draw.integers(0, 30)))) for n in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:3], (None, rows[5][1]), (None, None)], "doc_id long, text string")
    wide = Counter(tuple(r) for r in line_dedup.line_report(docs).collect())
    monkeypatch.setattr(line_dedup, "SIEVE_BITS", 1)
    assert Counter(tuple(r) for r in line_dedup.line_report(docs).collect()) == wide
    assert {(i, n) for (i, _, n, _) in wide if i is not None} == {(i, removed) for i, (_, removed, _) in _copied(rows).items()}


def test_line_runs_take_odd_rows(odd_docs):
    assert line_dedup.drop_repeated_lines(odd_docs).columns == odd_docs.columns
    rows = line_dedup.line_report(odd_docs).collect()
    assert len(rows) == len(ROWS)
    assert {r.text for r in rows if r.doc_id == 3} == {"same text here"}


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_embedding_groups(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(30, 16))
    points = np.vstack([base[k % 30] + draw.normal(scale=0.1 * (1 + k % 3), size=16) for k in range(400)]).astype(np.float32)
    rows = [(int(k), [float(x) for x in p], 0) for k, p in enumerate(points)]
    rows += [(1000, rows[0][1], 1), (1001, rows[0][1], 1), (1002, None, 0), (1003, [0.0] * 16, 0), (1004, [float("nan")] * 16, 0), (1005, [], 0)]
    rows += [(1006, [1.0] * 8, 0), (1007, [None] + [1.0] * 15, 0), (1008, [2.0] * 8, 0), (1008, [2.0] * 8, 0)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_groups(_vectors(spark, rows)).collect())
    good = [(i, np.array(e, dtype=np.float64)) for i, e, _ in rows if e and None not in e and np.isfinite(e).all() and any(e)]
    parent = {n: n for n in range(len(rows))}
    links = Counter()
    at = {n: np.array(r[1], dtype=np.float64) for n, r in enumerate(rows) if r[0] in {i for i, _ in good}}
    for m, x in at.items():
        for n, y in at.items():
            if m < n and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                links[m] += 1
                links[n] += 1
                a, b = find(parent, m), find(parent, n)
                parent[max(a, b)] = min(a, b)
    want = Counter()
    for n, row in enumerate(rows):
        least = min(rows[k][0] for k in range(len(rows)) if find(parent, k) == find(parent, n))
        want[(row[0], links[n], least, least == row[0])] += 1
    assert got == want


def test_mix_meets_the_targets(some_docs):
    rows = mixing.mix_report(some_docs).collect()
    assert sum(r.target for r in {r.source: r for r in rows}.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    most = max(r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * most
        assert own[0].target <= 2 * own[0].source_size + 1e-6
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)


def test_mix_takes_odd_rows(odd_docs):
    rows = mixing.mix_report(odd_docs).collect()
    assert len(rows) == len(ROWS)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in ROWS)
    assert Counter(rows) == Counter(mixing.mix_report(odd_docs.repartition(7)).collect())
    mixed = mixing.mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id != 3 AND n > 2").count() == 0


def test_empty_tables(spark, no_docs):
    for frame in (
        exact_dedup.exact_groups(no_docs),
        exact_dedup.drop_exact_copies(no_docs),
        near_dedup.near_report(no_docs),
        near_dedup.drop_near_copies(no_docs),
        line_dedup.line_report(no_docs),
        mixing.mix_report(no_docs),
        mixing.mix_documents(no_docs),
        embedding_dedup.embedding_groups(_vectors(spark, [])),
    ):
        assert frame.collect() == []
