"""SimHash near copies: fingerprints of shingles, linked through a hierarchical index in Gray order.

Fingerprints that differ in few bits share whole blocks of bits, so they are dealt by what stands under a block mask.
Such a group is one branch of the index: its fingerprints are sorted by Gray rank, runs of neighbours form
nodes that hold the bits all of them share, runs of nodes form upper nodes, and a search compares a fingerprint with
the bits that are new at a node, adds the differences up on its way down, and leaves a whole node once they exceed the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.lookup import attach
from tillscope.llm.components import components
from tillscope.llm.words import SPACED_LOWER, joined, pieces, signed, words_of
from tillscope.session import stage

SHINGLE, DISTANCE, SEED = 3, 3, 42
BITS = 64

#: Groups of more fingerprints are dealt again, by blocks of the bits that they don't share yet.
GROUP_ROWS = 4_000
#: How often; then 20 or 21 bits are left open, which bounds a group by itself.
DEPTH = 4
#: Children of a node of the index.
FANOUT = 16
#: Fingerprints that a worker indexes together (whole groups), and comparisons it makes at once.
INDEXED, COMPARED = 400_000, 2_000_000
#: Shingles whose bits are counted at once.
COUNTED = 200_000


def _fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text the bits that over half of its hashes have."""
    n = np.diff(first)
    total = np.zeros((len(n), BITS), np.int64)
    text = np.repeat(np.arange(len(n)), n)
    for a in range(0, len(hashes), COUNTED):
        part = hashes[a : a + COUNTED]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        owner = text[a : a + COUNTED]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
        total[owner[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    return np.packbits(2 * total > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(df: DataFrame, k: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``fingerprint`` (64 bits as a long) of every row.

    Words are lower-cased (A-Z) and separated by blanks, tabs and line ends; all ``k``-word shingles count, each as often as it
    stands there; fewer words are one shingle. A bit is set if more than half of the
    shingles' XXH64 values have it. Without words (null and empty texts) no bit is.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        for piece in pieces(batches, "text"):
            words = words_of(piece.column(1), SPACED_LOWER)
            n = np.diff(words.first)
            owner = np.repeat(np.arange(len(n)), n)
            out, edge = joined(lower[words.data], words.start, words.end, owner)
            data = out.tobytes()
            count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
            first = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
            text_of = np.repeat(np.arange(len(n)), count)
            a = words.first[:-1][text_of] + np.arange(first[-1]) - first[:-1][text_of]
            b = a + np.minimum(k, n)[text_of]
            stop = edge[b] - (b < words.first[1:][text_of])  # without the blank, unless the text ends there
            spans = zip(edge[a].tolist(), stop.tolist())
            hashes = np.fromiter((xxhash.xxh64_intdigest(data[x:y], SEED) for x, y in spans), np.uint64, first[-1])
            found = signed(_fingerprints(hashes, first))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found)], ["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {kind}, fingerprint long").withColumnRenamed("id", key)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sequence in which neighbours differ by one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


@dataclass
class _Level:
    """Nodes of one level: bits that all their fingerprints share, their values, and the children of node i, ``first[i]:first[i + 1]``."""

    shared: np.ndarray
    value: np.ndarray
    first: np.ndarray


class GrayIndex:
    """Groups of distinct fingerprints, each a tree; ``group`` names the group of each, in order, and codes are in Gray order inside.

    ``levels[0]`` are the fingerprints, the last level has one node for each group.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray, distance: int = DISTANCE) -> None:
        self.codes, self.distance = codes, distance
        every = np.full(len(codes), ~np.uint64(0))
        self.levels = [_Level(every, codes, np.arange(len(codes) + 1))]
        low, high = codes, codes
        while True:
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.append(edge, len(group)))
            if size.max() == 1:
                break
            within = np.arange(len(group)) - np.repeat(edge, size)
            edge = np.flatnonzero(within % FANOUT == 0)
            low, high = np.bitwise_and.reduceat(low, edge), np.bitwise_or.reduceat(high, edge)
            self.levels.append(_Level(~(low ^ high), low, np.append(edge, len(group))))
            group = group[edge]
        # the last fingerprint below each node
        self.last = [np.arange(len(codes))]
        for level in self.levels[1:]:
            self.last.append(self.last[-1][level.first[1:] - 1])
        self.root = np.repeat(np.arange(len(group)), np.diff(np.concatenate([[-1], self.last[-1]])))
        self.label = np.arange(len(codes))

    def _one_label(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and greatest label below each node, by level."""
        found = [(self.label, self.label)]
        for level in self.levels[1:]:
            a, b = found[-1]
            found.append((np.minimum.reduceat(a, level.first[:-1]), np.maximum.reduceat(b, level.first[:-1])))
        return found

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                return
            least = np.minimum(x, y)
            np.minimum.at(label, x, least)
            np.minimum.at(label, y, least)
            while True:
                further = label[label]
                if (further == label).all():
                    break
                label[:] = further

    def link(self) -> np.ndarray:
        """For every fingerprint the first one of its component, by links of at most ``distance`` bits in a group."""
        near = np.flatnonzero(np.bitwise_count(self.codes[1:] ^ self.codes[:-1]) <= self.distance)
        near = near[self.root[near] == self.root[near + 1]]
        self._unite(near, near + 1)
        top = len(self.levels) - 1
        for a in range(0, len(self.codes), COMPARED // FANOUT):
            query = np.arange(a, min(len(self.codes), a + COMPARED // FANOUT))
            self._search([(top, query, self.root[query], np.zeros(len(query), np.int64))])
        return self.label

    def _search(self, waiting: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Best effort first in depth: (level, query, node, differences above the node)."""
        labels = self._one_label()
        while waiting:
            at, query, node, differs = waiting.pop()
            level = self.levels[at]
            # only later fingerprints, and none of a node that is all in the query's component
            low, high = labels[at]
            own = self.label[query]
            open_ = (self.last[at][node] > query) & ~((low[node] == high[node]) & (self.label[low[node]] == own))
            query, node, differs = query[open_], node[open_], differs[open_]
            new = (self.codes[query] ^ level.value[node]) & level.shared[node]
            if at < len(self.levels) - 1:
                upper = self.levels[at + 1]
                above = np.searchsorted(upper.first, node, side="right") - 1
                new &= ~upper.shared[above]
            differs = differs + np.bitwise_count(new)
            near = differs <= self.distance
            query, node, differs = query[near], node[near], differs[near]
            if not len(query):
                continue
            if at == 0:
                self._unite(query, node)
                labels = self._one_label()
                continue
            size = level.first[node + 1] - level.first[node]
            for a, b in _slices(size, COMPARED):
                some = size[a:b]
                each = np.repeat(np.arange(a, b), some)
                child = level.first[node[each]] + np.arange(len(each)) - np.repeat(np.cumsum(some) - some, some)
                waiting.append((at - 1, query[each], child, differs[each]))


def _slices(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` children together."""
    block = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(size)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def block_masks(blocks: int, depth: int = DEPTH) -> list[list[int]]:
    """Masks by depth. Each of one depth adds one of ``blocks`` blocks of the bits that a mask of the depth before leaves open.

    The masks that extend mask i are ``blocks * i`` and the following ones.
    """
    levels, before = [], [0]
    for _ in range(depth):
        masks = []
        for mask in before:
            free = [bit for bit in range(BITS - 1, -1, -1) if not mask >> bit & 1]
            for b in range(blocks):
                part = free[b * len(free) // blocks : (b + 1) * len(free) // blocks]
                masks.append(mask | sum(1 << bit for bit in part))
        levels.append(masks)
        before = masks
    return levels


def _as_long(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _dealt(rows: DataFrame, masks: list[int], blocks: int) -> DataFrame:
    """Each fingerprint (``fp``, ``mask`` before) under the masks that extend its own: ``mask``, ``shared``, ``fp``."""
    table = F.array(*[F.lit(_as_long(m)) for m in masks])
    one = F.explode(F.sequence(F.col("mask") * blocks, F.col("mask") * blocks + (blocks - 1)))
    rows = rows.select(one.alias("mask"), "fp")
    return rows.withColumn("shared", F.col("fp").bitwiseAND(F.get(table, F.col("mask"))))


def _gray(code: Column) -> Column:
    """Gray rank as a long that sorts as the unsigned number."""
    ranked = reduce(lambda c, s: c.bitwiseXOR(F.shiftrightunsigned(c, s)), (1, 2, 4, 8, 16, 32), code)
    return ranked.bitwiseXOR(F.lit(-(1 << 63)))


def _linked(groups: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that span the components inside each group (``mask``, ``shared``) of fingerprints ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((3, 0), np.int64)]
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)]))
            if sum(h.shape[1] for h in held) < INDEXED:
                continue
            rows = np.concatenate(held, axis=1)
            change = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
            whole = change[-1] + 1 if len(change) else 0  # the last group may go on
            held = [rows[:, whole:]]
            yield from links(rows[:, :whole])
        yield from links(np.concatenate(held, axis=1))

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.shape[1] < 2:
            return
        group = np.concatenate([[0], np.cumsum((rows[:2, 1:] != rows[:2, :-1]).any(axis=0))])
        several = np.bincount(group)[group] > 1
        group, fp = group[several], rows[2, several]
        if not len(fp):
            return
        label = GrayIndex(fp.view(np.uint64), group, distance).link()
        met = label != np.arange(len(label))
        yield pa.RecordBatch.from_arrays([pa.array(fp[label[met]]), pa.array(fp[met])], ["a", "b"])

    dealt = groups.select("mask", "shared", "fp").repartition("mask", "shared")
    inside = dealt.sortWithinPartitions("mask", "shared", _gray(F.col("fp")))
    return inside.mapInArrow(run, "a long, b long")


def link_fingerprints(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) among distinct longs ``fp`` whose components are those of all pairs that differ by at most ``distance`` bits.

    Of ``distance + 1`` blocks of bits two near codes share at least one, whatever bits they are known to share
    before, so no link is lost when a large group is dealt again by blocks of its other bits.
    """
    blocks = distance + 1
    waiting, links = codes.select("fp", F.lit(0).alias("mask")), None
    for depth, masks in enumerate(block_masks(blocks)):
        dealt = stage(_dealt(waiting, masks, blocks), "blocks")
        large = dealt.groupBy("mask", "shared").count().where(F.col("count") > GROUP_ROWS)
        large = stage(large.select("mask", "shared"), "large-groups")
        if depth == DEPTH - 1 or large.isEmpty():
            found = _linked(dealt, distance)
            return found if links is None else links.union(found)
        found = stage(_linked(dealt.join(large, ["mask", "shared"], "left_anti"), distance), "links")
        links = found if links is None else links.union(found)
        waiting = dealt.join(large, ["mask", "shared"], "left_semi")
    raise AssertionError("the last depth returns")


def link_near_copies(
    df: DataFrame, k: int = SHINGLE, distance: int = DISTANCE, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key``, ``fingerprint`` (see ``fingerprints``) and ``component_id`` of every row.

    Two rows link when their fingerprints differ by at most ``distance`` bits, rows without words like any other;
    ``component_id`` is the smallest key reachable by links, the own one included. Repeated rows and rows of one key with
    different texts each give a row. Rows without key link as all do, but are nobody's smallest key; null if
    no key is reachable.

    Equal fingerprints are one node from the start, and only links that span components leave a
    task, so a large group of copies stays small.
    """
    marked = stage(fingerprints(df, k, text, key).toDF("id", "fp"), "fingerprints")
    classes = stage(marked.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    joined_ = components(link_fingerprints(classes, distance)).join(classes, F.col("node") == F.col("fp"))
    smallest = joined_.groupBy("component").agg(F.min("least").alias("of_component"))
    moved = joined_.join(smallest, "component").select("fp", "of_component")
    ids = classes.join(moved, "fp", "left").select("fp", F.coalesce("of_component", "least").alias("component_id"))
    # the rows of very many copies are split
    found = attach(marked, ids, ["fp"], how="inner")
    return found.select(F.col("id").alias(key), F.col("fp").alias("fingerprint"), "component_id")
