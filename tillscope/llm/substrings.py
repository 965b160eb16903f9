"""Removes passages that an earlier document, or an earlier place, has too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.words import SPACED, Words, mix, pieces, signed, window_hashes, words_of

#: Consecutive words of a passage, and of the shingles of which it is known by its smallest.
WINDOW, SHINGLE = 20, 4
#: Segments that are worked on together, and from how many on the windows of one anchor go separate ways.
BATCH_SEGMENTS, HOT_SEGMENTS, MOST_HOT = 100_000, 20_000, 1 << 16


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list[int]) -> None:
        """Adds a sequence; no substring crosses from the one before."""
        next_, link, length = self.next, self.link, self.length
        last = 0
        for x in sequence:
            if (to := next_[last].get(x)) is not None:
                # known already: go there, or to a copy that ends exactly here
                last = to if length[to] == length[last] + 1 else self._split(last, x, to)
                continue
            new = len(next_)
            next_.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and x not in next_[p]:
                next_[p][x] = new
                p = link[p]
            if p >= 0:
                q = next_[p][x]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, x, q)
            last = new

    def _split(self, p: int, x: int, q: int) -> int:
        next_, link, length = self.next, self.link, self.length
        copy = len(next_)
        next_.append(dict(next_[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and next_[p].get(x) == q:
            next_[p][x] = copy
            p = link[p]
        return copy

    def matches(self, sequence: list[int]) -> list[int]:
        """For every place the length of the longest suffix there that the automaton holds."""
        state, held, out = 0, 0, []
        for x in sequence:
            while state and x not in self.next[state]:
                state = self.link[state]
                held = self.length[state]
            if x in self.next[state]:
                state = self.next[state][x]
                held += 1
            out.append(held)
        return out


def anchors(words: Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Of every window the place of its smallest shingle, as runs of windows with the same one.

    Returns the anchor's hash, the document, and the first and the last window of each
    run, as places in the piece. Equal windows have equal anchors, wherever they stand.
    """
    n = len(words.hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none.view(np.uint64), none, none, none
    hashes = window_hashes(words.hashes, np.arange(n - k + 1), k)
    span = window - k + 1
    best = np.arange(len(hashes))
    reach = 1
    while reach < span:  # best[i]: the smallest of the next ``reach`` shingles, the leftmost of equals
        step = min(reach, span - reach)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(hashes[left] <= hashes[right], left, right)
        reach += step
    document = words.document()
    start = np.flatnonzero(document[: n - window + 1] == document[window - 1 :])
    if not len(start):
        return none.view(np.uint64), none, none, none
    at = best[start]
    new = np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return hashes[at[first]], document[start[first]], start[first], start[last]


def _anchors_of(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Segments of all documents: ``key`` (the anchor), ``content`` (a hash of its words), ``id``, ``first`` and ``last``.

    Of equal segments in a piece only the first goes on. The others are repeats, without
    ``content`` and with a key of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = words_of(piece.column(1), SPACED)
            hashes, document, first, last = anchors(words, window, k)
            if not len(hashes):
                continue
            content = window_hashes(words.hashes, first, last - first + window)
            ids, base = piece.column(0).to_numpy()[document], words.first[:-1][document]
            place = first - base
            order = np.lexsort((place, ids, content, hashes))
            same = np.append(
                False,
                (hashes[order][1:] == hashes[order][:-1]) & (content[order][1:] == content[order][:-1]),
            )
            again = np.append(
                False, same[1:] & (ids[order][1:] == ids[order][:-1]) & (place[order][1:] == place[order][:-1])
            )
            order, same = order[~again], same[~again]  # a repeated row is no repeat of its words
            apart = mix(ids[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place[order].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(np.where(same, apart, hashes[order]))),
                    pa.array(signed(content[order]), mask=same),
                    pa.array(ids[order]),
                    pa.array(place[order].astype(np.int32)),
                    pa.array((last - base)[order].astype(np.int32)),
                ],
                ["key", "content", "id", "first", "last"],
            )

    found = docs.mapInArrow(run, "key long, content long, id long, first int, last int")
    # both places in one long, mostly zeros, which keeps the largest shuffle small
    return found.select("key", "content", "id", (F.col("first") * F.lit(64).cast("long") + F.col("last") - F.col("first")).alias("at"))


def _sorted_out(found: DataFrame, window: int) -> DataFrame:
    """Segments with ``repeat`` (the whole segment stands earlier) and ``mixed`` (its anchor has other contents too)."""
    by = Window.partitionBy("key")
    order = by.orderBy("content", "id", "at")
    same = F.col("content") == F.lag("content").over(order)
    once = ~((F.col("id") == F.lag("id").over(order)) & (F.col("at") == F.lag("at").over(order)))
    told = found.withColumns(
        {
            "repeat": F.col("content").isNull() | (F.coalesce(same, F.lit(False)) & F.coalesce(once, F.lit(True))),
            "copy": F.coalesce(same & ~once, F.lit(False)),
            "mixed": F.coalesce(F.min("content").over(by) != F.max("content").over(by), F.lit(False)),
        }
    )
    first = F.floor(F.col("at") / 64).cast("int")
    return told.where("not copy and (repeat or mixed)").select(
        "key", "id", first.alias("first"), (first + (F.col("at") % 64).cast("int")).alias("last"), "repeat"
    )


def _hot_anchors(docs: DataFrame, window: int, k: int) -> np.ndarray:
    """Anchors of very many segments, counted where a piece has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            value, n = np.unique(anchors(words_of(piece.column(1), SPACED), window, k)[0], return_counts=True)
            often = n >= 3
            yield pa.RecordBatch.from_arrays([pa.array(signed(value[often])), pa.array(n[often])], ["anchor", "n"])

    counts = docs.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    hot = counts.where(F.col("n") >= HOT_SEGMENTS).orderBy(F.desc("n")).limit(MOST_HOT).collect()
    return np.array(sorted(r["anchor"] for r in hot), np.int64)


def _segments(docs: DataFrame, candidates: DataFrame, hot: np.ndarray, window: int) -> DataFrame:
    """The words around every anchor that repeats: all its windows, in one segment.

    Those of hot anchors are cut into single windows, which go by their own hash.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    runs = candidates.groupBy("id").agg(F.collect_list(F.struct("key", "first", "last")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = words_of(piece.column(1), SPACED)
            lists = piece.column(2)
            flat = lists.flatten()
            anchor, first, last = (flat.field(i).to_numpy() for i in range(3))
            document = np.repeat(np.arange(piece.num_rows), np.diff(lists.offsets.to_numpy()))
            is_hot = np.isin(anchor, sent.value)
            base = words.first[:-1][document]
            inside = base + last + window <= words.first[1:][document]  # another text may share the id
            begin = base + first
            whole = inside & ~is_hot
            single = np.flatnonzero(inside & is_hot)
            each = (last - first + 1)[single]
            inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            start = np.concatenate([begin[whole], np.repeat(begin[single], each) + inner])
            length = np.concatenate([(last - first)[whole] + window, np.full(len(inner), window, np.int64)])
            owner = np.concatenate([document[whole], np.repeat(document[single], each)])
            key = np.concatenate(
                [anchor[whole], signed(window_hashes(words.hashes, start[whole.sum() :], window))]
            ).astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(length)])
            place = np.arange(edge[-1]) + np.repeat(start - edge[:-1], length)
            values = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(signed(words.hashes[place])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key),
                    pa.array(piece.column(0).to_numpy()[owner]),
                    pa.array((start - words.first[:-1][owner]).astype(np.int32)),
                    values,
                ],
                ["key", "id", "first", "words"],
            )

    met = docs.join(runs, "id").select("id", "text", "runs")
    return met.mapInArrow(run, "key long, id long, first int, words array<long>")


def _repeats(key: np.ndarray, ids: np.ndarray, first: np.ndarray, edge: np.ndarray, flat: np.ndarray, window: int):
    """Spans (segment, from, to) of words that a window with an earlier equal one covers.

    The segments come by key, document and place. Each key has a suffix automaton of its
    segments so far, all earlier; the next segment runs through it, and where the longest match
    reaches the window a window ends that stands earlier too.
    """
    length = np.diff(edge)
    count = length - window + 1
    owner = np.repeat(np.arange(len(key)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + edge[:-1][owner]
    hashes = window_hashes(flat.view(np.uint64), start, window)
    _, of, times = np.unique(hashes, return_inverse=True, return_counts=True)
    # a segment without any window that shows up again neither matches nor is matched
    again = np.flatnonzero(np.bincount(owner, times[of] > 1, len(key)) > 0)
    spans: list[tuple[int, int, int]] = []
    current, automaton, seen, before = None, SuffixAutomaton(), set(), (None, None)
    for i in again.tolist():
        if key[i] != current:
            current, automaton, seen, before = key[i], SuffixAutomaton(), set(), (None, None)
        if before == (ids[i], first[i]):
            continue  # a repeated row
        before = (ids[i], first[i])
        words = flat[edge[i] : edge[i + 1]]
        content = words.tobytes()
        if content in seen:
            spans.append((i, 0, len(words)))
            continue
        seen.add(content)
        words = words.tolist()
        ends = [j for j, m in enumerate(automaton.matches(words)) if m >= window]
        opened = None
        for j in ends:
            if opened is not None and j - window + 1 <= opened[1]:
                opened = (opened[0], j + 1)
                continue
            if opened is not None:
                spans.append((i, *opened))
            opened = (j - window + 1, j + 1)
        if opened is not None:
            spans.append((i, *opened))
        if len(ends) < len(words) - window + 1:
            automaton.add(words)
    return np.array(spans, np.int64).reshape(-1, 3)


def _covered(segments: DataFrame, window: int) -> DataFrame:
    """Spans of words to remove: ``id``, ``start``, ``stop``."""

    def work(table: pa.Table) -> pa.RecordBatch:
        lists = table["words"].combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
        key, ids, first = (table[c].to_numpy() for c in ("key", "id", "first"))
        edge = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy()[edge[0] : edge[-1]]
        spans = _repeats(key, ids, first, edge - edge[0], flat, window)
        at = first[spans[:, 0]]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[spans[:, 0]]), *(pa.array((at + spans[:, c]).astype(np.int32)) for c in (1, 2))],
            ["id", "start", "stop"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH_SEGMENTS:
                table = pa.Table.from_batches(held)
                key = table["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if cut:
                    yield work(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows = table.num_rows - cut
        if held:
            yield work(pa.Table.from_batches(held))

    ordered = segments.repartition("key").sortWithinPartitions("key", "id", "first")
    return ordered.mapInArrow(run, "id long, start int, stop int")


def _kept(docs: DataFrame) -> DataFrame:
    """Words of ``text`` outside ``spans``, joined by blanks, and how many there were and went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = words_of(piece.column(1), SPACED)
            n = np.diff(words.first)
            lists = piece.column(2)
            size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            flat = lists.flatten()
            of = np.repeat(np.arange(len(n)), size)
            low, high = (np.minimum(flat.field(i).to_numpy(), n[of]) + words.first[:-1][of] for i in (0, 1))
            total = len(words.hashes)
            change = np.bincount(low, minlength=total + 1) - np.bincount(high, minlength=total + 1)
            keep = np.cumsum(change)[:-1] == 0
            keeps = np.concatenate([[0], np.cumsum(keep)])[words.first]
            start, end = words.start[keep], words.end[keep]
            width = end - start + 1  # with a blank behind it, but for a document's last
            last = keeps[1:][np.diff(keeps) > 0] - 1
            width[last] -= 1
            edge = np.concatenate([[0], np.cumsum(width)])
            place = np.arange(edge[-1]) + np.repeat(start - edge[:-1], width)
            blank = np.zeros(edge[-1], bool)
            blank[np.delete(edge[1:], last) - 1] = True
            out = np.where(blank, np.uint8(32), words.data[np.minimum(place, max(0, len(words.data) - 1))])
            texts = pa.Array.from_buffers(
                pa.string(), len(n), [None, pa.py_buffer(edge[keeps].astype(np.int32)), pa.py_buffer(out)]
            )
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(n.astype(np.int64)), pa.array(n - np.diff(keeps)), texts],
                ["id", "n_words", "n_removed", "kept"],
            )

    return docs.mapInArrow(run, "id long, n_words long, n_removed long, kept string")


def remove_repeats(
    df: DataFrame, window: int = WINDOW, k: int = SHINGLE, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Every text without the words of windows that stand earlier too.

    A window is ``window`` consecutive words of a document (words are separated by blanks, tabs and line ends, and unchanged).
    Its words go if the same sequence also starts in a document of smaller key, or earlier
    in this one. Returns ``key``, ``n_words``, ``n_removed`` and ``kept``, the other words joined by
    blanks. Null and empty texts have no words. Rows without key lose nothing, and nothing is lost to them. Rows of one
    key are one document: repeats of a row lose the same words.

    Shards of reference text can't all be sent everywhere, so windows are dealt by the smallest
    shingle in them, their anchor, which equal windows share. The windows around one anchor are a segment.
    Segments that meet no other at their anchor are unique; of segments of one content all but the first are repeats.
    Only where an anchor has several contents their words meet, and a
    suffix automaton of the earlier segments gives the matching statistics of the next.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    docs = rows.where("id is not null")
    found = _sorted_out(_anchors_of(docs, window, k), window)
    segments = _segments(docs, found.where("not repeat"), _hot_anchors(docs, window, k), window)
    whole = found.where("repeat").select("id", F.col("first").alias("start"), (F.col("last") + window).alias("stop"))
    spans = _covered(segments, window).union(whole)
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    cut = docs.join(spans, "id", "left").select("id", "text", F.coalesce("spans", none).alias("spans"))
    without = rows.where("id is null").select("id", "text", none.alias("spans"))
    return _kept(cut.union(without)).withColumnRenamed("id", key)
