"""Byte-level BPE encoding and decoding with lazily built transducers.

Encoding: a text is cut by the vocabulary's pattern and each piece is read
byte by byte by a finite-state transducer.  The last token of the encoding of
a prefix is unique, and a token sequence is the encoding of its bytes exactly
if every token stands for itself and every two neighbours do.  So a state
holds, for every place where a token may still be open, the trie node read
since then and the last token before it; reading a byte moves all of these at
once (a subset construction) and closes the longest open token that is
compatible with its predecessor.  That token is the move's output: the last
token of the encoding of all bytes read so far.  No place stays open longer
than the longest token, so the lookahead is bounded.  At the end of a piece the
outputs are followed back from the last byte, token by token.

States are built when first reached.  When ``max_states`` of them exist, all
are forgotten before the next pieces and built again as they are needed, so the
same moves are made whatever the bound.  States are packed bytes and moves sorted
arrays; only the moves of the last pieces are a dictionary.  The new pieces of
many texts walk at once, byte by byte, in arrays as large as the pieces; a piece
beyond WIDTH bytes walks alone.

Decoding: token bytes pass through an incremental UTF-8 decoder whose state is
the at most three bytes of an unfinished character; its moves are remembered
by (state, token).

Defined cases: a null text is empty and has no tokens; null ids decode to an
empty text; an unknown id or ill-formed bytes decode to U+FFFD; a column with
the name of the output is replaced; other columns are carried along.
"""

from __future__ import annotations

import array
import base64
import codecs
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Built states, remembered words and remembered pairs of tokens that a worker holds at most.
MAX_STATES = 200_000
MAX_WORDS = 500_000
MAX_PAIRS = 500_000
START = -1
PLACE = struct.Struct("ii")
#: Rows a batch that goes back to Spark, and characters that are read at once.
BATCH, CHARS = 1_000, 500_000
#: Bytes of a piece, and pieces, that walk at once.
WIDTH, WALKERS = 128, 65_536
#: Characters of a word that is worth remembering.
LONGEST = 100


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Moves:
    """Key -> next state: sorted arrays, and a dictionary of the keys that came since these were made."""

    def __init__(self):
        self.keys, self.after = np.array([1 << 62], dtype=np.int64), np.zeros(1, dtype=np.int32)
        self.fresh: dict[int, int] = {}

    def __len__(self) -> int:
        return len(self.keys) - 1 + len(self.fresh)

    def __setitem__(self, key: int, state: int) -> None:
        self.fresh[key] = state

    def get(self, key: int) -> int | None:
        state = self.fresh.get(key)
        if state is None:
            place = self.keys.searchsorted(key)
            state = int(self.after[place]) if self.keys[place] == key else None
        return state

    def settled(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after ``keys``, and the places of keys that the arrays don't have."""
        place = np.searchsorted(self.keys, keys)
        return self.after[place], np.flatnonzero(self.keys[place] != keys)

    def settle(self) -> None:
        """Take the dictionary's keys into the arrays, if it has more than a few."""
        count = len(self.fresh)
        if count > 0.05 * len(self.keys) + 1_000:
            keys = np.append(self.keys, np.fromiter(self.fresh.keys(), dtype=np.int64, count=count))
            after = np.append(self.after, np.fromiter(self.fresh.values(), dtype=np.int32, count=count))
            order = np.argsort(keys)
            self.keys, self.after, self.fresh = keys[order], after[order], {}


class Transducer:
    """Encodes pieces of bytes by ``ranks``."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.split: dict[int, tuple] = {}
        #: a slot a pair: the pair and whether it is compatible; a later pair of the same slot takes its place
        self.pairs = array.array("q", [-1]) * MAX_PAIRS
        # the trie: node and byte -> node, and the token that ends at a node
        self.child: dict[int, int] = {}
        self.token_at: list[int | None] = [None]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                after = self.child.get(node << 8 | byte)
                if after is None:
                    after = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(None)
                node = after
            if self.stands(rank):
                self.token_at[node] = rank
        #: nodes that go on; a place at any other one is over
        self.inner = {key >> 8 for key in self.child}
        self.length_of = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int32)
        for rank, token in self.bytes_of.items():
            self.length_of[rank] = len(token)
        self.forget()

    def forget(self) -> None:
        #: the places of a state: node and last token, PLACE each
        self.state_of: dict[bytes, int] = {}
        self.places: list[bytes] = []
        #: state << 8 | byte -> next state; the token it closes is the last one of the next state
        self.moves = Moves()
        self.token_of = np.zeros(1 << 10, dtype=np.int32)
        self.first = self._state([0, START])

    def _state(self, flat: list[int]) -> int:
        places = array.array("i", flat).tobytes()
        state = self.state_of.get(places)
        if state is None:
            state = self.state_of[places] = len(self.places)
            self.places.append(places)
            if state >= len(self.token_of):
                self.token_of = np.append(self.token_of, np.zeros_like(self.token_of))
            self.token_of[state] = flat[-1]
        return state

    def merge(self, piece: bytes, below: int | None = None) -> list[int]:
        """The definition: join the neighbours with the lowest rank (under ``below``), leftmost first, until none can be joined."""
        limit = len(self.ranks) if below is None else below
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= limit:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose joining makes ``token``; None for a byte, and () for a token no joining makes."""
        known = self.split.get(token, 0)
        if known == 0:
            parts = self.merge(self.bytes_of[token], token)
            known = self.split[token] = tuple(parts) if len(parts) == 2 else None if len(parts) == 1 else ()
        return known

    def stands(self, token: int) -> bool:
        """Whether the bytes of ``token`` are encoded as itself when no whole piece is looked up."""
        return self.halves(token) != ()

    def compatible(self, left: int, right: int) -> bool:
        """Whether both tokens together are encoded as themselves.

        The joinings next to their border are undone, latest first: the border is safe if at no time the two parts
        beside it could have been joined before the joining that was undone last.
        """
        pair = left << 20 | right
        slot = (left * 1_000_003 + right) % MAX_PAIRS
        known = self.pairs[slot]
        if known >> 1 == pair:
            return bool(known & 1)
        a, b, limit = left, right, len(self.ranks)
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < limit:
                known = False
                break
            above, below = self.halves(a), self.halves(b)
            if not above and not below:
                known = True
                break
            if above and (a > b or not below):
                limit, a = a, above[1]
            else:
                limit, b = b + 1, below[0]
        self.pairs[slot] = pair << 1 | known
        return known

    def _move(self, key: int) -> int:
        """The state after ``key`` (a state and a byte), built now."""
        places, closed, byte = [], None, key & 255
        for node, last in PLACE.iter_unpack(self.places[key >> 8]):
            after = self.child.get(node << 8 | byte)
            if after is None:
                continue
            if after in self.inner:
                places += after, last
            token = self.token_at[after]
            if closed is None and token is not None and (last == START or self.compatible(last, token)):
                closed = token
        places += 0, closed
        state = self.moves[key] = self._state(places)
        return state

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The states after ``keys``."""
        after, missing = self.moves.settled(keys)
        if len(missing):
            fresh = self.moves.fresh
            for i, key in zip(missing.tolist(), keys[missing].tolist()):
                state = fresh.get(key)
                after[i] = self._move(key) if state is None else state
        return after

    def _walk(self, pieces: list[bytes]) -> list[list[int]]:
        """Encodings of pieces of WIDTH bytes at most."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in order], dtype=np.int64)
        flat = np.frombuffer(b"".join(pieces[i] for i in order), dtype=np.uint8)
        begins = np.cumsum(sizes) - sizes
        state = np.full(len(sizes), self.first, dtype=np.int64)
        # the longest pieces come first, so the pieces that have a byte ``at`` are the first ones
        lives = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        starts = np.cumsum(lives) - lives
        closed = np.empty(len(flat), dtype=np.int32)
        for at, (live, start) in enumerate(zip(lives.tolist(), starts.tolist())):
            state[:live] = self._step(state[:live] << 8 | flat[begins[:live] + at])
            closed[start : start + live] = self.token_of[state[:live]]
        # from the last byte back, a token at a time
        at, row, steps = sizes.copy(), np.arange(len(sizes)), []
        while len(row):
            token = closed[starts[at[row] - 1] + row]
            steps.append((row, token))
            at[row] -= self.length_of[token]
            row = row[at[row] > 0]
        row, token = (np.concatenate([s[k] for s in reversed(steps)]) for k in (0, 1))
        sort = np.argsort(row, kind="stable")
        token, ends = token[sort].tolist(), np.cumsum(np.bincount(row, minlength=len(sizes))).tolist()
        out: list[list[int]] = [[]] * len(pieces)
        begin = 0
        for i, end in zip(order, ends):
            out[i] = token[begin:end]
            begin = end
        return out

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The encoding of every piece; pieces aren't empty."""
        if len(self.places) >= self.max_states:
            self.forget()
        else:
            self.moves.settle()
        out: list[list[int]] = []
        short: list[int] = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            out.append([whole] if whole is not None else [])
            if whole is None:
                if len(piece) <= WIDTH:
                    short.append(i)
                else:
                    out[i] = self._alone(piece)
        for begin in range(0, len(short), WALKERS):
            some = short[begin : begin + WALKERS]
            for i, ids in zip(some, self._walk([pieces[i] for i in some])):
                out[i] = ids
        return out

    def _alone(self, piece: bytes) -> list[int]:
        state, closed, moves = self.first, array.array("i"), self.moves
        for byte in piece:
            key = state << 8 | byte
            state = moves.get(key)
            if state is None:
                state = self._move(key)
            closed.append(self.token_of[state])
        out, at = [], len(closed)
        while at:
            out.append(closed[at - 1])
            at -= int(self.length_of[closed[at - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        return self.encode_all([piece])[0] if piece else []


class StreamDecoder:
    """Text of token ids, taken one at a time."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.codec = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def step(self, pending: bytes, token: int) -> tuple[str, bytes]:
        move = self.moves.get((pending, token))
        if move is None:
            self.codec.setstate((pending, 0))
            text = self.codec.decode(self.bytes_of.get(token, b"\xff"))
            move = self.moves[pending, token] = text, self.codec.getstate()[0]
        return move

    def decode(self, ids: Iterable[int]) -> str:
        pending, out, moves = b"", [], self.moves
        for token in ids:
            text, pending = moves.get((pending, token)) or self.step(pending, token)
            out.append(text)
        if pending:
            out.append("�")
        return "".join(out)


@lru_cache(maxsize=2)
def token_bytes(data: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(data).items()}


@lru_cache(maxsize=2)
def transducer(data: bytes) -> Transducer:
    """One transducer a worker process and vocabulary, kept between tasks."""
    return Transducer(read_ranks(data))


def pieces_of(pattern: str):
    """The cutter of a text; white space is Unicode's White_Space property, as the pattern's own library has it."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall


#: White space that ends a text or stands beside other white space; and a single space that doesn't.
_LOOSE = re.compile(r"\s\s|^\s|\s$")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


def encoder(machine: Transducer, pattern: str):
    """A function from texts to arrays of their ids.

    A single space between two characters that aren't white space always begins a piece, whatever is around.  So
    texts are cut there first, and each word (with the loose white space beside it) is cut by the pattern only when it
    isn't remembered.  Words are
    remembered in two generations of MAX_WORDS / 2; the older one goes when the newer is full.
    """
    cut = pieces_of(pattern)
    # ids as packed ints
    new: dict[str, bytes] = {}
    old: dict[str, bytes] = {}

    def learn(words: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't remembered; each of them, but the first of a text, has its blank before it."""
        cuts = [cut(word) for word in words]
        pieces = list({piece: None for found in cuts for piece in found})
        ids_of = dict(zip(pieces, machine.encode_all([piece.encode() for piece in pieces])))
        made = {}
        for word, found in zip(words, cuts):
            made[word] = array.array("i", [token for piece in found for token in ids_of[piece]]).tobytes()
        return made

    def encode(texts: list[str]) -> list[array.array]:
        nonlocal new, old
        split = [_SINGLE.split(text) if _LOOSE.search(text) else text.split(" ") for text in texts]
        # the first word of a text has no blank before it
        firsts = learn(list({words[0]: None for words in split}))
        unknown = {word for words in split for word in words[1:] if word not in new}
        for word in unknown & old.keys():
            new[word] = old[word]
        unknown = [word for word in unknown if word not in new]
        made = learn([" " + word for word in unknown])
        for word in unknown:
            new[word] = made[" " + word]
        out = []
        for words in split:
            out.append(array.array("i", b"".join([firsts[words[0]], *map(new.__getitem__, words[1:])])))
        for word in unknown:
            if len(word) > LONGEST:
                del new[word]
        if len(new) >= MAX_WORDS // 2:
            old, new = new, {}
        return out

    return encode


def slices(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in runs of about CHARS characters, or one longer text."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > CHARS:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """(rank file, pattern); the file of the public vocabulary unless a path is given."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def _with(schema: T.StructType, name: str, kind: T.DataType, drop: tuple[str, ...] = ()) -> T.StructType:
    gone = {name.lower(), *(d.lower() for d in drop)}
    return T.StructType([f for f in schema.fields if f.name.lower() not in gone] + [T.StructField(name, kind)])


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids", drop: tuple[str, ...] = (), decoded: str | None = None) -> DataFrame:
    """``docs`` without ``drop``, with the token ids of ``text`` as array<int> ``out``.

    With ``decoded``, the ids are decoded in the same pass, as ``decode`` would do it.
    """
    data, pattern = vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast(data)
    schema = _with(docs.schema, out, T.ArrayType(T.IntegerType(), False), drop)
    names = schema.names[:-1]
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, back = encoder(transducer(shared.value), pattern), StreamDecoder(transducer(shared.value).bytes_of)
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                batch = whole.slice(at, BATCH)
                flat, ends, texts = array.array("i"), array.array("i", [0]), []
                for part in slices([value or "" for value in batch.column(text).to_pylist()]):
                    for ids in many(part):
                        flat.extend(ids)
                        ends.append(len(flat))
                        if decoded:
                            texts.append(back.decode(ids))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids, *([pa.array(texts, pa.string())] if decoded else [])], schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of the token ids."""
    data, _ = vocabulary(path)
    shared = rows.sparkSession.sparkContext.broadcast(data)
    schema = _with(rows.schema, out, T.StringType())
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = StreamDecoder(token_bytes(shared.value))
        for batch in batches:
            texts = pa.array([decoder.decode(value.as_py() or ()) for value in batch.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), texts], [*names, out])

    return rows.mapInArrow(run, schema)


def token_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    coded = encode(docs.select("doc_id", "text"), path, drop=("text",), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
