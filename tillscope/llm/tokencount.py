"""Token counts by compiled transducers: a word splitter and a growing word lexicon."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.bpe import Merger, PairTable, shipped
from tillscope.llm.words import pieces

#: Characters of a chunk whose state map is computed on its own.
CHUNK = 256
#: Longer words are merged without becoming part of the lexicon.
LONGEST_WORD = 512
#: States of the lexicon that a worker keeps; beyond, it starts anew.
MOST_STATES = 600_000

# Character classes of the splitter.
SPACE, LETTER, NUMBER, OTHER, QUOTE, SHORT, R, V, L, E = range(10)
# States: nothing open; in letters; in other signs; a quote that opens a match; the same
# and then r, v or l, which is a suffix only if e, e or l follows.
FRESH, IN_LETTERS, IN_SIGNS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
# Outputs: a word begins here; a word began at the character before; both.
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for state and class, of the pattern: quoted suffix, letters, digit, signs."""
    go = np.zeros((7, 10), np.uint8)
    out = np.zeros((7, 10), np.uint8)
    letters = (LETTER, SHORT, R, V, L, E)

    def put(state, kinds, to, sign=0):
        go[state, list(kinds)] = to
        out[state, list(kinds)] = sign

    for state in range(7):
        put(state, (SPACE,), FRESH)
        put(state, letters, IN_LETTERS, HERE)
        put(state, (NUMBER,), FRESH, HERE)
        put(state, (OTHER,), IN_SIGNS, HERE)
        put(state, (QUOTE,), QUOTED, HERE)
    put(IN_LETTERS, letters, IN_LETTERS)
    for state in (IN_SIGNS, QUOTED):
        put(state, (OTHER, QUOTE), IN_SIGNS)
    put(QUOTED, (SHORT,), FRESH)
    for kind, state, last in ((R, QUOTED_R, E), (V, QUOTED_V, E), (L, QUOTED_L, L)):
        put(QUOTED, (kind,), state)
        put(state, letters, IN_LETTERS)
        out[state] |= BEFORE
        put(state, (last,), FRESH)
    return go, out


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    every = [chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000)]
    table = np.full(0x110000, OTHER, np.uint8)
    text = "".join(every)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, text):
            table[m.start() : m.end()] = kind
    for letters, kind in (("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in letters]] = kind
    table[ord("'")] = QUOTE
    return table


def run_states(kinds: np.ndarray, go: np.ndarray) -> np.ndarray:
    """The state before every character, from ``FRESH``.

    The text is cut into chunks. Each gets the map from any state at its begin to the
    state at its end; a parallel prefix scan composes the maps, which gives the true
    state at each begin, and all chunks then run side by side.
    """
    n, states = len(kinds), len(go)
    if not n:
        return np.zeros(0, np.uint8)
    rows = -(-n // CHUNK)
    padded = np.zeros(rows * CHUNK, np.uint8)
    padded[:n] = kinds
    steps = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    flat = go.T.ravel()  # by class, then state
    maps = np.broadcast_to(np.arange(states, dtype=np.uint8), (rows, states)).copy()
    for kind in steps:
        maps = flat[(kind.astype(np.uint16) * states)[:, None] + maps]
    reach = 1
    while reach < rows:  # after the round, map i spans the 2 * reach chunks up to i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    state = np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.uint8)
    before = np.empty_like(steps)
    for j, kind in enumerate(steps):
        before[j] = state
        state = flat[kind.astype(np.uint16) * states + state]
    return before.T.ravel()[:n]


class Lexicon:
    """A transducer over the bytes of words, compiled as words turn up.

    A transition is found by hashing (state, byte). ``emits`` holds the number of
    tokens that the transition out of a state at a word's end emits, -1 where no word
    ended yet.
    """

    def __init__(self) -> None:
        self.bits = 16
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int32)
        self.emits = np.full(1024, -1, np.int32)
        self.states = 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots that hold the keys, or the free slots where they would go; which are held."""
        slot, mask = self._slot(keys), len(self.keys) - 1
        here = self.keys[slot]
        open_ = np.flatnonzero((here != keys) & (here != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            here = self.keys[slot[open_]]
            open_ = open_[(here != keys[open_]) & (here != -1)]
        return slot, self.keys[slot] == keys

    def _add(self, keys: np.ndarray, to: np.ndarray) -> None:
        while len(keys):
            slot, _ = self._find(keys)
            _, first = np.unique(slot, return_index=True)
            self.keys[slot[first]], self.to[slot[first]] = keys[first], to[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to = keys[rest], to[rest]

    def _grow(self, more: int) -> None:
        if (self.states + more) * 5 > len(self.keys) * 2:
            held = self.keys >= 0
            keys, to = self.keys[held], self.to[held]
            while (self.states + more) * 5 > 1 << self.bits:
                self.bits += 1
            self.keys = np.full(1 << self.bits, -1, np.int64)
            self.to = np.zeros(1 << self.bits, np.int32)
            self._add(keys, to)
        if self.states + more > len(self.emits):
            wider = np.full(2 * (self.states + more), -1, np.int32)
            wider[: self.states] = self.emits[: self.states]
            self.emits = wider

    def ends(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The state at the end of every word; all words advance one byte a step."""
        order = np.argsort(-length, kind="stable")
        begin, left = start[order], np.sort(length)
        state = np.zeros(len(start), np.int64)
        for j in range(int(length.max(initial=0))):
            active = len(left) - np.searchsorted(left, j, side="right")
            keys = (state[:active] << 8) | data[begin[:active] + j]
            slot, held = self._find(keys)
            if not held.all():
                new = np.unique(keys[~held])
                self._grow(len(new))
                self._add(new, np.arange(self.states, self.states + len(new), dtype=np.int32))
                self.states += len(new)
                slot, _ = self._find(keys)
            state[:active] = self.to[slot]
        out = np.empty(len(start), np.int64)
        out[order] = state
        return out


def letter_of_byte() -> list[str]:
    """The printable letter that vocabularies of byte-level BPE write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts of one tokenizer file: lower-cased words, byte-level BPE with an end-of-word mark."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # ids follow the order of the merges, so the id is the rank
        merged = [vocabulary[a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(merged, merged[1:])):
            raise ValueError(f"{path}: ids must rise with the rank of the merges")
        left, right = ([vocabulary[p[i]] for p in pairs] for i in (0, 1))
        self.merger = Merger(PairTable(np.array(left), np.array(right), np.array(merged)))
        letters = letter_of_byte()
        self.inner = np.array([vocabulary[x] for x in letters])
        self.last = np.array([vocabulary[x + end] for x in letters])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        self.go, self.out = _splitter()
        self.flat_out = self.out.ravel()
        self.lexicon = Lexicon()

    def _bpe(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each of the words, by merging."""
        place = np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)
        ids = self.inner[data[place]]
        ends = np.cumsum(length) - 1
        ids[ends] = self.last[data[place[ends]]]
        return self.merger.merge(ids, length)[1]

    def _words(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each of the words, from the lexicon."""
        if self.lexicon.states > MOST_STATES:
            self.lexicon = Lexicon()
        count = np.zeros(len(start), np.int64)
        short = length <= LONGEST_WORD
        state = self.lexicon.ends(data, start[short], length[short])
        unknown, at = np.unique(state, return_index=True)
        new = self.lexicon.emits[unknown] < 0
        unknown, at = unknown[new], np.flatnonzero(short)[at[new]]
        self.lexicon.emits[unknown] = self._bpe(data, start[at], length[at])
        count[short] = self.lexicon.emits[state]
        if not short.all():
            count[~short] = self._bpe(data, start[~short], length[~short])
        return count

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            split = self.special.split(text) if "<" in text else [text]
            total[i] += len(split) - 1
            parts += split
            owner += [i] * len(split)
        # a capital sigma becomes the same letter wherever it stands
        normal = [unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() + " " for p in parts]
        joined = "".join(normal)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = _classes()[points]
        before = run_states(kinds, self.go)
        sign = self.flat_out[before.astype(np.uint16) * 10 + kinds]
        begins = (sign & HERE) > 0
        begins[:-1] |= (sign[1:] & BEFORE) > 0
        stops = np.flatnonzero(begins | (kinds == SPACE))
        first = begins[stops]
        # in bytes
        wide = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
        offset = np.concatenate([[0], np.cumsum(wide)])
        start = offset[stops[first]]
        length = offset[np.append(stops[1:], len(points))[first]] - start
        count = self._words(np.frombuffer(joined.encode(), np.uint8), start, length)
        edge = np.cumsum([len(p) for p in normal])
        of = np.asarray(owner)[np.searchsorted(edge, stops[first], side="right")]
        return total + np.bincount(of, count, len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    df: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Tokens of every text under a tokenizer file, without added special tokens.

    Returns ``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``
    tokens). Special strings inside a text count one token each. A null or empty text
    has no bytes and no tokens; null keys, repeated rows and other columns make no
    difference. One pass over the rows, no shuffle.
    """
    name = shipped(df, path)
    schema = f"`{key}` {dict(df.dtypes)[key]}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(SparkFiles.get(name))
        for piece in pieces(batches, "text"):
            column = pc.fill_null(piece.column(1), "")
            count = counter.count(column.to_pylist())
            size = pc.cast(pc.binary_length(column), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), size, pa.array(count), pa.array(count > limit)],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)
