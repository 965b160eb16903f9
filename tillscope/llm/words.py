"""Vectorised words, hashes and shingles over Arrow text, a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together, which bounds a worker's memory; a longer document is a piece of its own.
PIECE_BYTES = 3 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(separators: set[int], lower: bool) -> np.ndarray:
    """Byte to byte, 0 for a separator."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[sorted(separators | {0})] = 0
    return table


_SPACE = {0x20, *range(0x09, 0x0E)}
_NOT_ALNUM = {*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)} - set(range(65, 91))

# What is a word, as tables from bytes to bytes. NUL is never a letter of these
# texts' words except between blanks, where it gets a value of its own below.
SPACED = _table(_SPACE, lower=False).astype(np.uint16)
SPACED_LOWER = _table(_SPACE, lower=True).astype(np.uint16)
ALNUM_LOWER = _table(_NOT_ALNUM, lower=True).astype(np.uint16)
for _words in (SPACED, SPACED_LOWER):
    _words[0] = 256


@dataclass
class Words:
    """The words of a piece: ``first[i]:first[i + 1]`` are those of document i."""

    first: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = n + n // 4
        self.up = np.full(size, _BASE, np.uint64)
        self.up[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        self.down = np.full(size, _INVERSE, np.uint64)
        self.down[0] = 1
        np.multiply.accumulate(self.down, out=self.down)


_powers = _Powers()


def window_hashes(values: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hash of ``values[start:start + length]`` for every start, by one running sum."""
    _powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, _powers.up[: len(values)], out=total[1:])
    np.cumsum(total, out=total)
    return mix((total[start + length] - total[start]) * _powers.down[start])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: none) and where each text starts, and the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, table: np.ndarray) -> Words:
    """All words of the texts; ``table`` says which bytes belong to a word, and maps case."""
    data, offsets = text_bytes(texts)
    mapped = table[data]
    inside = mapped != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] |= inside[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    ends[edge] |= inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = window_hashes(mapped.astype(np.uint64), start, end - start)
    return Words(np.searchsorted(start, offsets), hashes, start, end, data)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of a few megabytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size, dtype=np.int64) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def distinct_shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each document, sorted by hash, and where each set starts.

    A document of fewer words has its whole word sequence as the only shingle.
    """
    n = np.diff(words.first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    owner = np.repeat(np.arange(len(n)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = words.first[:-1][owner] + within
    hashes = window_hashes(words.hashes, start, np.minimum(k, n)[owner])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(len(n) + 1))


def signed(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes as the long values that Spark has."""
    return hashes.view(np.int64)


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given words, those of a group joined by blanks: bytes, and where each word starts in them.

    ``group`` says of each word, in order, whose it is. The next word's start (or the end) is one
    blank behind a word's end, but for the last word of a group, which has no blank.
    """
    width = end - start + 1
    last = np.ones(len(start), bool)
    last[:-1] = group[1:] != group[:-1]
    width[last] -= 1
    edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(width, dtype=np.int64)])
    place = np.arange(edge[-1]) + np.repeat(start - edge[:-1], width)
    blank = np.zeros(edge[-1], bool)
    blank[edge[1:][~last] - 1] = True
    if not edge[-1]:
        return np.zeros(0, np.uint8), edge
    return np.where(blank, np.uint8(32), data[np.minimum(place, len(data) - 1)]), edge
