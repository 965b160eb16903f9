"""Runs of periodically repeated words, found by suffix arrays, and texts without the repeats.

A piece of many texts is worked on at once in numpy. Words get codes of their own in every text, and
every text ends in a code of its own, so no interval of the suffix array spans two texts.
Ranks by the first 1, 2, 4, ... words are kept: they give the suffix array, its inverse (ISA), the common
prefixes (LCP), and later the way a square can be rotated to the left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.words import SPACED, joined, pieces, words_of

#: A run has at least this many words, and at least this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


@dataclass
class Suffixes:
    """Enhanced suffix array of a code sequence; ``ranks[i]`` orders suffixes by their first 2**i codes."""

    order: np.ndarray
    place: np.ndarray
    lcp: np.ndarray
    ranks: list[np.ndarray]


def _groups(values: np.ndarray) -> np.ndarray:
    """For sorted values the index of the first equal one."""
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))


def suffixes(codes: np.ndarray) -> Suffixes:
    """Suffix array by prefix doubling; only suffixes that still tie are sorted again.

    ``codes`` are ranks (the number of smaller codes in the sequence), and the last code is unique.
    """
    n = len(codes)
    rank, ranks, width = codes.astype(np.int64), [], 1
    size = np.bincount(rank, minlength=n)
    active = np.flatnonzero(size[rank] > 1)
    while True:
        ranks.append(rank.astype(np.int32))
        if not len(active):
            break
        # a unique code lies before the end, so active suffixes reach at least ``width`` further
        key = rank[active] * n + rank[np.minimum(active + width, n - 1)]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        head = _groups(rank[active])
        same = _groups(key)
        rank = rank.copy()
        rank[active] += same - head
        count = np.bincount(same, minlength=len(same))
        active = active[count[same] > 1]
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    common = np.zeros(max(0, n - 1), np.int64)
    tied = np.flatnonzero(codes[a] == codes[b])
    for level in range(len(ranks) - 1, -1, -1):
        r = ranks[level]
        x, y = a[tied] + common[tied], b[tied] + common[tied]
        common[tied] += np.where(r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)], 1 << level, 0)
    return Suffixes(order, rank, np.concatenate([np.zeros(1, np.int64), common]), ranks)


def _jump(lcp: np.ndarray, at: np.ndarray, step: int, strict: bool) -> np.ndarray:
    """For boundaries ``at`` the next one in direction ``step`` whose value is smaller (or equal, unless ``strict``).

    A boundary points to its neighbour, then over all that the one it points to knows to be larger.
    Values of 0 end every interval, so nothing needs to pass one.
    """
    to = np.arange(len(lcp)) + step
    open_ = at
    while len(open_):
        here, there = lcp[open_], lcp[to[open_]]
        over = there >= here if strict else there > here
        open_ = open_[over]
        to[open_] = to[to[open_]]
    return to[at]


def branching_squares(s: Suffixes, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of all squares that don't go on to the right.

    The two halves of such a square start two suffixes that part right behind their common prefix, the half:
    they lie in one LCP interval, in different children, so at least one lies outside the largest child. For each of the other
    suffixes i of an interval of depth d the inverse array says whether i + d or i - d lies in it as well.
    """
    n = len(codes)
    lcp = np.concatenate([s.lcp, np.zeros(1, np.int64)])
    at = np.flatnonzero(lcp > 0)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none
    depth = lcp[at]
    # an interval holds the suffixes low..high; its boundaries of value ``depth`` part its children
    low = _jump(lcp, at, -1, True)
    high = _jump(lcp, at, 1, True) - 1
    left = _jump(lcp, at, -1, False)
    after = _jump(lcp, at, 1, False)
    final = after == high + 1
    first = np.concatenate([left, at[final]])
    stop = np.concatenate([at, high[final] + 1])
    low, high, depth = (np.concatenate([v, v[final]]) for v in (low, high, depth))
    # the largest child of each interval is left out, the first of equal ones
    by = np.lexsort((first, first - stop, depth, low))
    low, high, depth, first, stop = (v[by] for v in (low, high, depth, first, stop))
    least = np.ones(len(low), bool)
    least[1:] = (low[1:] == low[:-1]) & (depth[1:] == depth[:-1])
    least[0] = False
    low, high, depth, first, stop = (v[least] for v in (low, high, depth, first, stop))
    size = stop - first
    child = np.repeat(np.arange(len(size)), size)
    i = s.order[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    d, lo, hi = depth[child], low[child], high[child]
    found = []
    for other, start in ((i + d, i), (i - d, i - d)):
        inside = (other >= 0) & (other < n)
        j = s.place[np.where(inside, other, 0)]
        inside &= (j >= lo) & (j <= hi)
        begin, half = start[inside], d[inside]
        ends = codes[begin + half] != codes[np.minimum(begin + 2 * half, n - 1)]
        found.append((begin[ends], half[ends]))
    begin, half = (np.concatenate(v) for v in zip(*found))
    return begin, half


def _rotated(s: Suffixes, begin: np.ndarray, half: np.ndarray) -> np.ndarray:
    """How far each square can be moved to the left: the same word leaves behind as enters in front."""
    start = begin.copy()
    for level in range(len(s.ranks) - 1, -1, -1):
        width = 1 << level
        to = start - width
        r = s.ranks[level]
        same = (to >= 0) & (r[np.maximum(to, 0)] == r[np.maximum(to, 0) + half])
        start = np.where(same, to, start)
    return start


def runs_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all maximal repetitions of two periods or more, by start and end."""
    s = suffixes(codes)
    begin, half = branching_squares(s, codes)
    start, end = _rotated(s, begin, half), begin + 2 * half
    by = np.lexsort((half, end, start))
    start, end, half = start[by], end[by], half[by]
    # multiples of a period have the same stretch
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[keep], end[keep], half[keep]


def _codes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, a unique one behind each text, and where each text starts among them."""
    n = np.diff(first)
    begin = first[:-1] + np.arange(len(n))
    total = len(hashes) + len(n)
    text = np.repeat(np.arange(len(n)), n)
    codes = np.empty(total, np.int64)
    by = np.argsort(hashes, kind="stable")  # texts stay in order inside a hash
    new = np.ones(len(by), bool)
    new[1:] = (hashes[by][1:] != hashes[by][:-1]) | (text[by][1:] != text[by][:-1])
    codes[by + text[by]] = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    codes[begin + n] = len(hashes) + np.arange(len(n))
    return codes, begin


#: From seeds (0 or more, for texts that have one) and numbers of words (1 or more): the word from which a text loops, and
#: the loop's length (0: none).
Loop = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _looped(n: np.ndarray, first: np.ndarray, seeds: pa.Array, loop: Loop) -> np.ndarray:
    """The word that stands at each place, with the loops of texts that have a seed and words."""
    begin, length = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    some = pc.is_valid(seeds).to_numpy(zero_copy_only=False) & (n > 0)
    begin[some], length[some] = loop(pc.fill_null(seeds, 0).to_numpy()[some], n[some])
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(first[-1]) - first[:-1][text]
    a, p = begin[text], length[text]
    return first[:-1][text] + np.where((p > 0) & (place >= a), a + (place - a) % np.maximum(p, 1), place)


def _lists(first: np.ndarray, **columns: np.ndarray) -> pa.Array:
    """Lists of structs; those of row i are ``first[i]:first[i + 1]``."""
    structs = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), structs)


def _collapsed(piece: pa.RecordBatch, loop: Loop | None) -> pa.RecordBatch:
    """Runs and other words of the texts of one piece (id, text, seed)."""
    words = words_of(piece.column(1), SPACED)
    first, n = words.first, np.diff(words.first)
    source = np.arange(len(words.hashes))
    if loop is not None:
        source = _looped(n, first, piece.column(2), loop)
    codes, begin = _codes(words.hashes[source], first)
    start, end, period = runs_of(codes)
    long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, end, period = start[long], end[long], period[long]
    text = np.searchsorted(begin, start, side="right") - 1
    by = np.lexsort((period, start))
    start, end, period, text = start[by], end[by], period[by], text[by]
    # drop what follows the first period
    change = np.bincount(start + period, minlength=len(codes) + 1) - np.bincount(end, minlength=len(codes) + 1)
    keep = np.delete(np.cumsum(change)[: len(codes)] == 0, begin + n)
    owner = np.repeat(np.arange(len(n)), n)[keep]
    kept = source[keep]
    out, edge = joined(words.data, words.start[kept], words.end[kept], owner)
    offsets = edge[np.searchsorted(owner, np.arange(len(n) + 1))].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            piece.column(0),
            pa.array(n.astype(np.int64)),
            _lists(
                np.searchsorted(text, np.arange(len(n) + 1)), start=start - begin[text], length=end - start, period=period
            ),
            pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(out)]),
        ],
        ["id", "n_words", "runs", "collapsed"],
    )


def find_runs(
    df: DataFrame, seed: Column | None = None, loop: Loop | None = None, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Runs of repeated words of every text, and the text without the repeats.

    Words are separated by blanks, tabs and line ends, and unchanged. A run is a stretch of words with a
    smallest period q, of at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods, that
    no neighbouring word extends. Returns ``key``, ``n_words``, ``runs`` (start, length, period; by start,
    then period) and ``collapsed``: the words that no run has behind its first period, joined by blanks.
    Null and empty texts have no words and no runs. Every row gives a row, repeated ones and those without key too.

    ``loop`` may plant loops first: of the texts whose ``seed`` (a column of longs) is not null, each
    word from the place it names on is replaced by the one that stands there in the loop.

    One pass without a shuffle. Texts of a few megabytes are worked on together, a longer one alone.
    Words are told apart by 64-bit hashes, inside a text.
    """
    none = F.lit(None)
    rows = df.select(
        F.col(key).alias("id"), F.col(text).alias("text"), (none if seed is None else seed).cast("long").alias("seed")
    )
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield _collapsed(piece, loop)

    found = rows.mapInArrow(run, f"id {kind}, n_words long, runs {RUN_TYPE}, collapsed string")
    return found.withColumnRenamed("id", key)


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones that of smallest start, then period. Null without runs."""
    order = F.transform(
        runs, lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c"), r.alias("run"))
    )
    return F.array_min(order)["run"]
