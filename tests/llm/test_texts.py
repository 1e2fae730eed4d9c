import random

import numpy as np
import pandas as pd
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from anamnesis.llm import bpe, licenses, main_text, pii, toxicity
from tests.llm.cases import ROWS


@pytest.fixture(scope="module")
def library():
    data, pattern = bpe.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(data), special_tokens={})


def _strings():
    draw = random.Random(4)
    tokens = list(bpe.read_ranks(bpe.vocabulary()[0]))
    yield from ("", " ", "  a", "a \n b", "it's\t\tDONE", "x" * 3_000, "é́ü　\x1c\x85 z", "<|endoftext|>")
    for _ in range(1_500):
        yield "".join(draw.choice("aab c\n\t.1é'stlv") for _ in range(draw.randint(1, 40)))
        yield b"".join(draw.choice(tokens) for _ in range(draw.randint(1, 6))).decode("utf-8", "ignore")
        yield "".join(chr(draw.choice([draw.randint(32, 0x2FFF), draw.randint(0x1F300, 0x1FAFF)])) for _ in range(10))


@pytest.mark.parametrize("states", [1, 50, bpe.MAX_STATES])
def test_transducer_agrees_with_the_library(library, states):
    data, pattern = bpe.vocabulary()
    machine = bpe.Transducer(bpe.read_ranks(data), max_states=states)
    one, back = bpe.encoder(machine, pattern), bpe.StreamDecoder(machine.bytes_of)
    for text in _strings():
        ids = list(one([text])[0])
        assert ids == library.encode_ordinary(text)
        assert back.decode(ids) == text


def test_decoder_takes_any_ids(library):
    back = bpe.StreamDecoder(bpe.token_bytes(bpe.vocabulary()[0]))
    half = library.encode_single_token("é".encode()[:1])
    assert back.decode([half]) == "�" and back.decode([60_000]) == "�" and back.decode([]) == ""


def test_encode_and_decode_frames(odd_docs, no_docs, library):
    coded = bpe.decode(bpe.encode(odd_docs)).collect()
    assert len(coded) == len(ROWS)
    for row in coded:
        assert list(row.ids) == library.encode_ordinary(row.text or "") and row.decoded == (row.text or "")
    assert bpe.token_report(no_docs).collect() == []
    assert bpe.token_report(odd_docs).filter("doc_id = 4").first().n_tokens == 0


def test_licenses(odd_docs, no_docs, spark):
    mit, notice = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0 (notice)"]
    changed = mit.replace("merge, ", "").replace("persons", "people")
    texts = [f"Intro. {changed} Outro.", f"{notice} Then {notice}", "a license for nothing", None, "", "Licensed under the"]
    rows = licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    names = {r.doc_id: [m.license for m in r.licenses] for r in rows}
    assert names == {0: ["MIT"], 1: ["Apache-2.0 (notice)"] * 2, 2: [], 3: [], 4: [], 5: []}
    match = next(r for r in rows if r.doc_id == 0).licenses[0]
    assert 0.95 < match.coverage < 1 and texts[0][match.start : match.end] == changed[:-1]
    assert licenses.license_report(odd_docs).count() == len(ROWS)
    assert licenses.license_report(no_docs).collect() == []
    assert licenses.license_report(odd_docs, templates={}).agg(F.sum("n_licenses")).first()[0] == 0


def _luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms(spark, odd_docs, no_docs):
    card, date = "4785380592391139", "1984-02-29"
    texts = [f"card {card} of a@b.example.org, {date}", f"again {card}$$$ and {date}; 4111111111111112", "10.0.0.255 300.1.1.1 +1 (415) 555-0100", "plain text of 12 words", None, ""]
    rows = {r.doc_id: r for r in pii.private_values(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    new = rows[0].text.split()
    assert new[1] != card and len(new[1]) == 16 and _luhn(new[1]) and new[1] == rows[1].text.split()[1].rstrip("$")
    assert new[3].endswith(".org,") and "@" in new[3] and "a@b" not in new[3]
    assert new[4] == rows[1].text.split("and ")[1][:10] != date
    assert "4111111111111112" in rows[1].text and "300.1.1.1" in rows[2].text and "10.0.0.255" not in rows[2].text
    assert all(int(x) < 256 for x in rows[2].text.split()[0].split("."))
    assert (rows[3].text, rows[4].text, rows[5].text) == ("plain text of 12 words", None, "")
    assert [rows[i].n_private for i in range(6)] == [3, 2, 2, 0, 0, 0]
    other = pii.private_values(spark.createDataFrame([(0, texts[0])], "doc_id long, text string"), key="another").first()
    assert other.text != rows[0].text
    assert pii.pseudonymise(odd_docs).columns == [*odd_docs.columns, "n_private"]
    assert pii.private_values(no_docs).collect() == []


def test_pseudonyms_are_a_permutation(spark):
    numbers = spark.range(10_000).select("id", F.lpad(F.col("id").cast("string"), 4, "0").alias("digits"))
    mixed = numbers.select(F.expr(pii._digits("digits", "'k'")).alias("p"))
    assert mixed.distinct().count() == 10_000 and mixed.filter("length(p) != 4").count() == 0


def test_main_text():
    page = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav>Menu</nav><div class="ad">Buy</div><article><h1>Head &amp; tail</h1>'
        '<p>One <b>two</b>s<br>three<p>four</p><aside>side</aside><form>f</form><section class="reader-comments"><p>no</p></section></article><footer>f</footer>'
    )
    assert main_text.read_page(page) == (["Head & tail", "One twos three", "four"], True)
    assert main_text.read_page("<p>a<p>b<style>p{}") == (["a", "b"], False)
    assert main_text.read_page("") == ([], False)


def test_boilerplate_of_unmarked_pages(spark, no_docs):
    shared = "all rights reserved by the owners of this site forever"
    own = [f"<p>{' '.join(f'{w}{i}' for i in range(12))}</p>" for w in "abcd"]
    rows = [(k, f"http://h.example/{k}", f"<div>{shared}</div>{text}") for k, text in enumerate(own)]
    rows += [(9, "http://other.example/", f"<div>{shared}</div>"), (10, None, None), (11, "http://h.example/x", "")]
    got = {r.page_id: r.text for r in main_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == " ".join(f"a{i}" for i in range(12)) and got[9] == shared and got[10] == got[11] == ""
    empty = no_docs.selectExpr("doc_id AS page_id", "source AS url", "text AS html")
    assert main_text.main_texts(empty).collect() == []


def test_toxicity_on_held_out_labels(spark):
    draw = random.Random(8)
    syllables = ["ta", "lo", "mi", "ren", "sho", "ke", "bu", "an"]
    insults = ["grobnik", "plotzer", "zwackel"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    rows, labels = [], []
    for i in range(900):
        words, toxic = [word() for _ in range(40)], i % 5 == 0
        if toxic:
            words[draw.randrange(40)] = draw.choice(insults)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    changed = ["gro.bnik", "plotxzer", "z w a c k e l", "ZWACKEL!!"]
    rows += [(1_000 + k, " ".join([word() for _ in range(20)] + [c])) for k, c in enumerate(changed)] + [(2_000, None), (2_001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, known).collect()}
    right = [got[i].predicted == t for i, _, t in labels if got[i].held_out]
    assert len(right) > 150 and sum(right) / len(right) > 0.97
    assert all(got[1_000 + k].predicted == 1 for k in range(len(changed)))
    assert got[2_000].score == got[2_001].score < 0.3


def test_toxicity_takes_odd_rows(spark, odd_docs, no_docs):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity_report(odd_docs, nothing).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1, 1), (2, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity_report(odd_docs, one).collect()} == {1.0}
    assert toxicity.toxicity_report(no_docs, nothing).collect() == []
    assert toxicity.drop_toxic(odd_docs, nothing).columns == odd_docs.columns


def test_pipeline_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
    assert docs.filter("NOT round_trip").count() == 0 and docs.count() > 0


def test_most_moves_of_new_words_are_known(some_docs):
    """Beyond the first words nearly all bytes move between states that exist, and blank lines don't change the ids."""
    data, pattern = bpe.vocabulary()
    machine = bpe.Transducer(bpe.read_ranks(data))
    texts = [r.text or "" for r in some_docs.collect()]
    words = sorted({f" {w}" for t in texts for w in t.split()})
    random.Random(2).shuffle(words)
    half = len(words) // 2
    machine.encode_all([w.encode() for w in words[:half]])
    before = len(machine.moves)
    machine.encode_all([w.encode() for w in words[half:]])
    assert len(machine.moves) - before < 0.35 * sum(len(w.encode()) for w in words[half:])
    many = bpe.encoder(machine, pattern)
    loose = [t.replace(". ", ".\n\n").replace(", ", ",  ") + "\n" for t in texts]
    import tiktoken

    library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=machine.ranks, special_tokens={})
    assert [list(ids) for ids in many(loose)] == library.encode_ordinary_batch(loose)


def test_toxicity_holds_the_words_of_some_texts_only():
    class Lengths:
        bias, most = -1.0, 0

        def margins(self, words):
            self.most = max(self.most, len(words))
            return np.array([float(len(w)) for w in words])

    machine = Lengths()
    texts = pd.Series([f"w{i} {'x' * (i % 7)}" for i in range(3_000)] + ["", None])
    got = toxicity.best_margins(machine, texts, {})
    assert list(got) == [max(map(len, toxicity.raw_words(t or "")), default=-1) for t in texts]
    assert machine.most <= 2 * toxicity.TEXTS_PER_STEP


def test_states_and_moves_are_held_compactly():
    """Bytes that a worker keeps for each state it has built, with its moves."""
    import tracemalloc

    data, _ = bpe.vocabulary()
    ranks = bpe.read_ranks(data)
    machine, draw, tokens = bpe.Transducer(ranks), random.Random(5), [t for t in ranks if t.isalpha()]
    pieces = [b"".join(draw.choice(tokens) for _ in range(4)) for _ in range(5_000)]
    tracemalloc.start()
    assert len(machine.encode_all(pieces)) == len(pieces)
    machine.encode_all(pieces[:1])
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 300 * len(machine.places)
