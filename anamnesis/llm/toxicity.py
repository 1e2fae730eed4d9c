"""Toxic texts by a support vector machine over a gap-weighted subsequence kernel.

The kernel of two strings sums, over all character triples they share in
order, DECAY to the power of the stretch each one takes, so an insult with a
gap or an inserted character keeps most of its weight.  It is used on windows
of WINDOW characters of words (letters and digits only, lower case; letters
written apart are put together again).  Landmarks are the character sequences
whose document frequency tells the classes apart best; the Nyström map
K^(-1/2) k(., landmarks) turns the kernel machine into a linear one.

Labels belong to whole texts, so training is multi-instance: the sentence word
that scores highest stands for a toxic text, and the highest words of clean
texts are the examples against it; ROUNDS rounds of choosing and fitting.  A
text's score is the calibrated score of its highest word.  As kernel and map
are linear in the triples, all landmarks fold into one table of triple
weights, and scoring a word costs the same for any number of landmarks.

Bounds: at most SAMPLE labelled texts of the classes are fitted on, taken by a
hash of their id; every text is scored whole.  The model knows every character
of the landmarks, and holds a weight for each triple and a row of the alphabet's
size for each pair of characters that they have in order.

Defined cases: a null text is empty, an empty text scores as the machine's
threshold does (no word), labels that are null play no part, without labels of
both classes every score is the share of toxic labels (0 without labels),
repeated rows score alike, extra columns play no part.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.base import free_name
from anamnesis.session import materialize

#: Toxic and clean labelled texts that the machine is fitted on at most.
SAMPLE = (1_500, 4_000)
LANDMARKS = 96
ROUNDS = 4
THRESHOLD = 0.3
DECAY = 0.6
WINDOW, STRIDE = 12, 4
#: A triple may stretch over so many characters.
STRETCH = 8
GRAMS = (4, 5, 6, 7, 8)
MIN_TEXTS = 3
CACHE = 200_000
# texts whose words are held at once
TEXTS_PER_STEP = 256

TRIPLES = [t for t in itertools.combinations(range(WINDOW), 3) if t[2] - t[0] < STRETCH]
_APART = re.compile(r"(?:(?<=\s)|^)\w(?:\s+\w){2,}(?=\s|$)")
_NOISE = re.compile(r"[\W_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def raw_words(text: str) -> list[str]:
    """Words of a text in lower case; three or more single characters in a row also count as one word."""
    low = text.lower()
    return low.split() + ["".join(m.split()) for m in _APART.findall(low)]


def windows(word: str) -> list[str]:
    """The word's letters and digits between marks of its ends, in windows that overlap when it is long."""
    plain = f"^{_NOISE.sub('', word)}$"
    if len(plain) <= WINDOW:
        return [plain] if len(plain) > 4 else []
    return [plain[at : at + WINDOW] for at in range(0, len(plain) - WINDOW + STRIDE, STRIDE)]


class Alphabet:
    """Codes of the landmarks' characters; 0 stands for all others and matches nothing."""

    def __init__(self, landmarks: list[str]):
        seen = sorted({c for mark in landmarks for c in mark})
        self.code = {ord(c): i + 1 for i, c in enumerate(seen)}
        self.symbols = len(seen) + 1
        self.dtype = np.min_scalar_type(len(seen))

    def codes(self, strings: list[str]) -> np.ndarray:
        code = self.code
        flat = (code.get(ord(c), 0) for string in strings for c in string.ljust(WINDOW, "\0"))
        return np.fromiter(flat, dtype=self.dtype, count=len(strings) * WINDOW).reshape(-1, WINDOW)

    def triples(self, string: str) -> dict[tuple[int, int, int], float]:
        """The feature vector of a string: triple of codes -> weight."""
        vector: dict[tuple[int, int, int], float] = {}
        codes = self.codes([string])[0].astype(int)
        for i, j, k in TRIPLES:
            if codes[i] and codes[j] and codes[k]:
                at = (int(codes[i]), int(codes[j]), int(codes[k]))
                vector[at] = vector.get(at, 0.0) + DECAY ** (k - i + 1)
        return vector


class Triples:
    """Rows of the triples in use, found through the rows of their first two characters; row 0 is for all others."""

    def __init__(self, symbols: int, used: list[tuple[int, int, int]]):
        pairs = {pair: i + 1 for i, pair in enumerate(sorted({t[:2] for t in used}))}
        self.symbols = symbols
        self.pairs = np.zeros(symbols * symbols, dtype=np.int32)
        self.rows = np.zeros((len(pairs) + 1) * symbols, dtype=np.int32)
        for (i, j), pair in pairs.items():
            self.pairs[i * symbols + j] = pair
        for row, (i, j, k) in enumerate(used):
            self.rows[pairs[i, j] * symbols + k] = row + 1

    def of(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        return self.rows[self.pairs[first * self.symbols + second] * self.symbols + third]


def weigh(codes: np.ndarray, table: np.ndarray, triples: Triples) -> np.ndarray:
    """Sum of table[triple's row] * DECAY^stretch over the triples of every row of codes."""
    total = np.zeros((len(codes), *table.shape[1:]), dtype=np.float32)
    for at in range(0, len(codes), 8_192):
        some = codes[at : at + 8_192].astype(np.int32)
        for i, j, k in TRIPLES:
            total[at : at + 8_192] += np.float32(DECAY ** (k - i + 1)) * table[triples.of(some[:, i], some[:, j], some[:, k])]
    return total


class Machine:
    """The fitted model: score of a word = triple weights of its best window + bias."""

    def __init__(self, landmarks: list[str]):
        self.alphabet = Alphabet(landmarks)
        vectors = [self.alphabet.triples(mark) for mark in landmarks]
        norms = [np.sqrt(sum(v * v for v in vector.values())) or 1.0 for vector in vectors]
        used = sorted({at for vector in vectors for at in vector})
        self.rows = Triples(self.alphabet.symbols, used)
        row = {triple: i + 1 for i, triple in enumerate(used)}
        self.basis = np.zeros((len(used) + 1, len(landmarks)), dtype=np.float32)
        for column, (vector, norm) in enumerate(zip(vectors, norms)):
            for at, weight in vector.items():
                self.basis[row[at], column] = weight / norm
        gram = self.basis.T.astype(np.float64) @ self.basis
        values, axes = np.linalg.eigh(gram)
        keep = values > 1e-6
        self.whiten = axes[:, keep] / np.sqrt(values[keep])
        self.table = self.basis.sum(axis=1)
        self.bias, self.slope, self.offset = 0.0, 1.0, 0.0

    def features(self, codes: np.ndarray) -> np.ndarray:
        return weigh(codes, self.basis, self.rows).astype(np.float64) @ self.whiten

    def set(self, weights: np.ndarray, bias: float) -> None:
        self.table = (self.basis @ (self.whiten @ weights).astype(np.float32)).astype(np.float32)
        self.bias = bias

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the windows of all words, and the number of each window's word."""
        cut = [windows(word) for word in words]
        owner = np.repeat(np.arange(len(words)), [len(ws) for ws in cut])
        return self.alphabet.codes([w for ws in cut for w in ws]), owner

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of every word: its best window's; the bias alone for words without windows."""
        return self.margins_of(*self.cut(words), len(words))

    def margins_of(self, codes: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
        best = np.zeros(words)
        if len(owner):
            # windows come in the order of their words
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best[owner[first]] = np.maximum.reduceat(weigh(codes, self.table, self.rows), first)
        return best + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine in the primal by Newton steps; the bias is the last weight, unpenalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        inside = y * (x @ w) < 1
        xa = x[inside] * cost[inside, None]
        new = np.linalg.solve(penalty + xa.T @ x[inside], xa.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid with his smoothed targets."""
    positives = toxic.sum()
    goal = np.where(toxic, (positives + 1) / (positives + 2), 1 / (len(toxic) - positives + 2))
    design = np.stack([margin, np.ones(len(margin))], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        hessian = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (goal - p) - 1e-3 * (line - [1.0, 0.0]))
        line = line + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(line[0]), 1e-3), float(line[1])


def _text_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = [sorted({_NOISE.sub("", w) for w in raw_words(text or "")} - {""}) for text in batch["text"]]
        yield pd.DataFrame({"toxic": batch["toxic"], "part": batch["part"], "words": [" ".join(w) for w in words]})


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for toxic, words in zip(batch["toxic"], batch["words"]):
            grams = {w[at : at + n] for word in words.split() for w in [f"^{word}$"] for n in GRAMS for at in range(len(w) - n + 1)}
            yield pd.DataFrame({"gram": sorted(grams), "toxic": toxic})


def _sample(docs: DataFrame, labels: DataFrame, sample: tuple[int, int]) -> DataFrame:
    """toxic, part (0 to 3, by a hash) and distinct words of the texts to fit on."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    mixed = F.xxhash64("doc_id")
    chosen = None
    for kind, most in zip((1, 0), sample):
        some = known.filter(F.col("toxic") == kind).withColumn("part", F.pmod(mixed, F.lit(4)).cast("int")).orderBy(mixed, "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "part", "text")
    return texts.mapInPandas(_text_words, "toxic int, part int, words string")


def choose_landmarks(words: DataFrame, texts: tuple[int, int], wanted: int = LANDMARKS) -> list[str]:
    """Character sequences by how far their document frequency tells the classes apart (G², signed)."""
    clean, toxic = texts
    counts = (
        words.mapInPandas(_grams, "gram string, toxic int")
        .groupBy("gram")
        .agg(F.sum("toxic").alias("a"), F.sum(F.lit(1) - F.col("toxic")).alias("b"))
        .filter(F.col("a") + F.col("b") >= MIN_TEXTS)
    )
    all_texts = clean + toxic
    cells = [("a", toxic, 1), ("b", clean, 1), ("a", toxic, 0), ("b", clean, 0)]
    g2 = F.lit(0.0)
    for column, size, has in cells:
        seen = F.col(column) if has else F.lit(size) - F.col(column)
        expected = (F.col("a") + F.col("b") if has else F.lit(all_texts) - F.col("a") - F.col("b")) * F.lit(size / all_texts)
        g2 = g2 + F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    scored = materialize(counts, "grams").withColumn("g2", g2).withColumn("for", F.col("a") * F.lit(clean) > F.col("b") * F.lit(toxic))
    picked: list[str] = []
    for side, share in ((True, wanted * 3 // 4), (False, wanted)):
        rows = scored.filter(F.col("for") == side).orderBy(F.desc("g2"), F.length("gram").desc(), "gram").limit(wanted * 20).collect()
        for row in rows:
            if len(picked) >= share:
                break
            if not any(row["gram"] in mark or mark in row["gram"] or _overlap(row["gram"], mark) for mark in picked):
                picked.append(row["gram"])
    return picked


def _overlap(a: str, b: str) -> bool:
    """Whether the strings share a run of all but one of the shorter one's characters."""
    n = min(len(a), len(b)) - 1
    return any(a[at : at + n] in b for at in range(len(a) - n + 1))


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Machine | float:
    """The machine, or the share of toxic labels when a class is missing."""
    words = materialize(_sample(docs, labels, sample), "labelled-words")
    # the same order whatever the partitions were
    rows = sorted(words.collect(), key=lambda r: (r["toxic"], r["part"], r["words"]))
    toxic = np.array([r["toxic"] for r in rows], dtype=bool)
    if not len(rows) or toxic.all() or not toxic.any():
        return float(toxic.mean()) if len(rows) else 0.0
    # clean texts are many: a quarter of them is enough to compare frequencies
    part = np.array([r["part"] for r in rows])
    counted = words.filter("part > 0 AND (toxic = 1 OR part = 1)")
    landmarks = choose_landmarks(counted, (int((~toxic & (part == 1)).sum()), int((toxic & (part > 0)).sum())))
    if not landmarks:
        return float(toxic.mean())
    machine = Machine(landmarks)
    number: dict[str, int] = {}
    texts = [np.array([number.setdefault(w, len(number)) for w in r["words"].split()], dtype=np.int64) for r in rows]
    vocabulary = list(number)
    del rows, number
    use = part > 0
    codes, owner = machine.cut(vocabulary)
    # at first a word is as good as the best landmark it holds
    worth = {mark: 1.0 - at / len(landmarks) for at, mark in enumerate(landmarks)}
    held = lambda w: max((worth.get(w[at : at + n], 0.0) for n in GRAMS for at in range(len(w) - n + 1)), default=0.0)
    margins = np.array([held(f"^{w}$") for w in vocabulary])
    against = np.empty(0, dtype=np.int64)
    for _ in range(ROUNDS):
        # the windows that stand for a word: the best ones of toxic texts, the three best words' of clean ones
        order = np.lexsort((-weigh(codes, machine.table, machine.rows), owner))
        window_of = np.full(len(vocabulary), -1)
        window_of[owner[order][::-1]] = order[::-1]
        best = [t[np.argsort(-margins[t], kind="stable")[: 1 if is_toxic else 3]] for t, is_toxic, fitted in zip(texts, toxic, use) if fitted]
        sides = toxic[use]
        picked = lambda side: window_of[np.concatenate([b for b, s in zip(best, sides) if s == side] or [[]]).astype(np.int64)]  # noqa: B023, E731
        witnesses, others = picked(True), picked(False)
        witnesses, against = witnesses[witnesses >= 0], np.union1d(against, others[others >= 0])
        if len(witnesses) and len(against):
            y = np.r_[np.ones(len(witnesses)), -np.ones(len(against))]
            cost = np.where(y > 0, 5.0 * len(y) / len(witnesses), 5.0 * len(y) / len(against))
            machine.set(*fit_linear(machine.features(codes[np.r_[witnesses, against]]), y, cost))
        margins = machine.margins_of(codes, owner, len(vocabulary))
    best = np.array([margins[t].max() if len(t) else machine.bias for t in texts])
    # the part that wasn't fitted calibrates, if it has enough of both classes
    judge = ~use if min(toxic[~use].sum(), (~toxic[~use]).sum()) >= 30 else np.ones(len(texts), dtype=bool)
    machine.slope, machine.offset = calibrate(best[judge], toxic[judge])
    del machine.basis, machine.whiten
    return machine


def best_margins(machine: Machine, texts: pd.Series, known: dict[str, float]) -> np.ndarray:
    """Highest margin of the words of each text, the words of some texts at a time; ``known`` keeps margins of words."""
    best = np.empty(len(texts))
    for at in range(0, len(texts), TEXTS_PER_STEP):
        cut = [raw_words(text or "") for text in texts.iloc[at : at + TEXTS_PER_STEP]]
        new = list({w for words in cut for w in words if w not in known})
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list({w for words in cut for w in words})
        known.update(zip(new, machine.margins(new).tolist()))
        best[at : at + len(cut)] = [max(map(known.__getitem__, words), default=machine.bias) for words in cut]
    return best


def score(docs: DataFrame, model: Machine | float, out: str = "score") -> DataFrame:
    """``docs`` with the score of every text."""
    if isinstance(model, float):
        return docs.withColumn(out, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine, known = shared.value, {}
        for part in parts:
            yield pd.Series(machine.probability(best_margins(machine, part, known)))

    return docs.withColumn(out, of("text"))


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score under the threshold."""
    name = free_name(docs, "score")
    return score(docs, fit(docs, labels, sample), name).filter(F.col(name) < threshold).select(docs.columns)
