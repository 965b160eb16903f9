"""Byte-level BPE: whole texts to ids and back, merging padded matrices of words."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.words import pieces

#: Words of more bytes are merged one by one through a heap.
LONGEST_ROW = 256
#: Words that a worker remembers; beyond, it forgets all and goes on.
REMEMBERED = 200_000

_NONE = np.int64(1) << 40


class PairTable:
    """Open addressing from a pair of ids to the id of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, ~np.uint64(0))
        self.values = np.full(1 << self.bits, _NONE)
        self.probes = 0
        slot, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            self.probes += 1
            free = self.keys[slot[open_]] == ~np.uint64(0)
            # of several keys for one free slot the first gets it
            _, first = np.unique(slot[open_[free]], return_index=True)
            won = open_[free][first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], merged[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            open_ = open_[lost[open_]]
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, a huge number where a pair never merges or an id is negative."""
        keys = (left.astype(np.int64).view(np.uint64) << np.uint64(32)) | (
            right.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)
        )
        found = np.full(keys.shape, _NONE)
        slot = self._slot(keys)
        open_ = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        flat_keys, flat_slot, flat_found = keys.ravel(), slot.ravel(), found.ravel()
        for _ in range(self.probes):
            at = flat_slot[open_]
            here = self.keys[at]
            hit = here == flat_keys[open_]
            flat_found[open_[hit]] = self.values[at[hit]]
            go = ~hit & (here != ~np.uint64(0))
            open_ = open_[go]
            if not len(open_):
                break
            flat_slot[open_] = (flat_slot[open_] + 1) & (len(self.keys) - 1)
        return flat_found.reshape(keys.shape)


class Merger:
    """BPE merges of many short id sequences at once."""

    def __init__(self, pairs: PairTable) -> None:
        self.pairs = pairs

    def merge(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of the rows that stand one after the other in ``ids``, ``count[i]`` ids each."""
        begin = np.cumsum(count) - count
        bucket = np.where(count <= 4, 4, 1 << np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, their lengths, their ids
        for width in np.unique(bucket):
            members = np.flatnonzero(bucket == width)
            if width > LONGEST_ROW:
                for i in members:
                    row = np.array(self._heap(ids[begin[i] : begin[i] + count[i]].tolist()), np.int64)
                    done.append((np.array([i]), np.array([len(row)]), row))
                continue
            for part in np.array_split(members, -(-len(members) * int(width) // 400_000)):
                self._matrix(ids, begin[part], count[part], part, done)
        # back into the order of the rows
        length = np.zeros(len(count), np.int64)
        for rows, lengths, _ in done:
            length[rows] = lengths
        at = np.cumsum(length) - length
        out = np.empty(length.sum(), np.int64)
        for rows, lengths, values in done:
            inner = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out[np.repeat(at[rows], lengths) + inner] = values
        return out, length

    def _matrix(self, flat, begin, count, members, done) -> None:
        """Every round merges the leftmost pair of least rank of every row, then drops finished rows."""
        width = int(count.max(initial=1))
        columns = np.arange(width)
        filled = columns < count[:, None]
        ids = np.full((len(members), width), -1, np.int64)
        ids[filled] = flat[(begin[:, None] + columns)[filled]]
        ranks = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while len(members):
            if ids.shape[1] > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(members)), at]
                going = best < _NONE
            else:
                going = np.zeros(len(members), bool)
            if not going.all():
                rest = ids[~going]
                real = rest >= 0
                done.append((members[~going], real.sum(axis=1), rest[real]))
                if not going.any():
                    return
                members, ids, ranks, at, best = members[going], ids[going], ranks[going], at[going], best[going]
            each = np.arange(len(members))
            ids[each, at] = best
            columns = np.arange(ids.shape[1] - 1)
            ids = ids[each[:, None], columns + (columns > at[:, None])]
            columns = np.arange(ids.shape[1] - 1)
            ranks = ranks[each[:, None], columns + (columns >= at[:, None])]
            # the pairs on both sides of the merged token are new
            left = at > 0
            r, c = each[left], at[left]
            ranks[r, c - 1] = self.pairs.get(ids[r, c - 1], ids[r, c])
            right = at < ids.shape[1] - 1
            r, c = each[right], at[right]
            ranks[r, c] = self.pairs.get(ids[r, c], ids[r, c + 1])

    def _rank(self, a: int, b: int) -> int:
        return int(self.pairs.get(np.array([a]), np.array([b]))[0])

    def _heap(self, ids: list[int]) -> list[int]:
        """One long row: pairs wait in a heap by rank and place."""
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        arr = np.array(ids)
        ranks = self.pairs.get(arr[:-1], arr[1:]).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self._rank(ids[x], ids[y])) < _NONE:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


def pair_table(vocabulary: dict[bytes, int]) -> PairTable:
    """Every way to make a token of two tokens."""
    left, right, merged = [], [], []
    for token, rank in vocabulary.items():
        for cut in range(1, len(token)):
            a, b = vocabulary.get(token[:cut]), vocabulary.get(token[cut:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                merged.append(rank)
    return PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int64))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and a number in each line."""
    with open(path, "rb") as lines:
        parts = (line.split() for line in lines)
        return {base64.b64decode(p[0]): int(p[1]) for p in parts if p}


class Coder:
    """Encodes and decodes with one rank file and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.find = regex.compile(pattern).findall
        self.merger = Merger(pair_table(ranks))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens])
        self.begin = np.cumsum(self.length) - self.length
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if len(self.known) > REMEMBERED:
            self.forget()
        found = [self.find(t) for t in texts]
        new = list(set().union(*found).difference(self.known))
        spelled = [w.encode() for w in new]
        size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        merged, count = self.merger.merge(self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)], size)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.flat = np.concatenate([self.flat, merged.astype(np.int32)])
        self.count = np.concatenate([self.count, count])
        words = np.fromiter(map(len, found), np.int64, len(found))
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, words.sum())
        begin, length = np.cumsum(self.count) - self.count, self.count[index]
        place = np.arange(length.sum()) + np.repeat(begin[index] - (np.cumsum(length) - length), length)
        edges = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(words)])]
        return self.flat[place], np.diff(edges)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and how many bytes each id has."""
        length = self.length[ids]
        offset = np.cumsum(length) - length
        place = np.arange(length.sum()) + np.repeat(self.begin[ids] - offset, length)
        return self.letters[place], length


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> Coder:
    return Coder(read_ranks(path), pattern)


def shipped(df: DataFrame, path: str) -> str:
    """Sends a vocabulary file to the executors; returns the name to look it up by."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _lists(values: pa.Array, count: np.ndarray, kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return kind.from_arrays(pa.array(offsets), values)


def encode_decode(
    df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Ids of every text and the bytes they stand for.

    ``path`` names a rank file, ``pattern`` splits texts into words that are merged
    apart. Returns ``key``, ``ids`` (array of int) and ``decoded`` (binary). A null or
    empty text has no ids and no bytes; a null key, repeated rows and other columns make
    no difference. One pass over the rows, no shuffle: words of similar length form a
    padded matrix, every round merges the leftmost pair of least rank of each row by a
    hashed pair lookup, and finished rows leave the matrix. Only words longer than
    ``LONGEST_ROW`` bytes go through a heap, which finds the same merges.
    """
    name = shipped(df, path)
    schema = f"`{key}` {dict(df.dtypes)[key]}, ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(SparkFiles.get(name), pattern)
        for piece in pieces(batches, "text"):
            ids, count = coder.encode([t or "" for t in piece.column(1).to_pylist()])
            decoded, length = coder.decode(ids)
            edges = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(count)])]
            binary = pa.Array.from_buffers(
                pa.binary(), len(count), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(decoded)]
            )
            lists = _lists(pa.array(ids, pa.int32()), count, pa.ListArray)
            yield pa.RecordBatch.from_arrays([piece.column(0), lists, binary], [key, "ids", "decoded"])

    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)
