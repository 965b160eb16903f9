"""Benchmark passages in documents, found through an FM-index of every training shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.words import ALNUM_LOWER, pieces, words_of

#: Consecutive item words of a test phrase.
WINDOW = 13
#: Bytes of benchmark text that one broadcast holds; more text makes more passes.
BLOCK_BYTES = 2 << 20
#: One suffix position in so many is kept.
SAMPLE = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence, bit by bit from the highest."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = symbols
        for bit in range(bits - 1, -1, -1):
            is_one = (level >> bit) & 1
            ones = np.zeros(len(level) + 1, np.int32)
            np.cumsum(is_one, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(level) - int(ones[-1]))
            mask = is_one.astype(bool)
            level = np.concatenate([level[~mask], level[mask]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        first = np.zeros_like(upto)
        for ones, zeros, bit in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1)):
            one = ((symbol >> bit) & 1).astype(bool)
            upto = np.where(one, zeros + ones[upto], upto - ones[upto])
            first = np.where(one, zeros + ones[first], first - ones[first])
        return upto - first


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes in order, by doubling the compared prefix until all differ."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    reach = 1
    while n:
        key = rank.astype(np.int64) * (n + 1)
        key[:-reach] += rank[reach:] + 1
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], (np.diff(key[order]) != 0).cumsum()])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order
        reach *= 2
    return np.zeros(0, np.int64)


class FMIndex:
    """Finds phrases in runs of symbols (1 and up); no phrase crosses the end of a run."""

    def __init__(self, symbols: np.ndarray, run_end: np.ndarray, alphabet: int) -> None:
        """``run_end`` marks the last symbol of every run; ``alphabet`` is the largest symbol."""
        runs = int(run_end.sum())
        # behind each run stands an end mark of its own, which sorts before all symbols
        place = np.arange(len(symbols)) + np.cumsum(run_end) - run_end
        text = np.empty(len(symbols) + runs, np.int64)
        text[place] = symbols + runs - 1
        marks = place[run_end] + 1
        text[marks] = np.arange(runs)
        order = suffix_order(text)
        text[marks] = 0
        text[place] = symbols
        self.source = np.full(len(text), -1, np.int64)
        self.source[place] = np.arange(len(symbols))
        self.last = text[order - 1]
        self.tree = WaveletMatrix(self.last, max(1, int(alphabet).bit_length()))
        counts = np.bincount(text, minlength=alphabet + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        # kept: every so many positions, and the begin of each run, where walking back ends
        kept = np.arange(len(text)) % SAMPLE == 0
        kept[0] = True
        kept[(marks + 1)[marks + 1 < len(text)]] = True
        self.kept = kept[order]
        self.kept_rank = np.cumsum(self.kept) - 1
        self.position = order[self.kept]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the sorted suffixes that begin with each phrase, by backward search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        for back in range(1, int(length.max(initial=0)) + 1):
            at = np.flatnonzero((length >= back) & (low < high))
            symbol = phrases[at, length[at] - back]
            base = self.before[symbol]
            low[at] = base + self.tree.rank(symbol, low[at])
            high[at] = base + self.tree.rank(symbol, high[at])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin: back to a kept one, then its position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.kept[rows])
        while len(open_):
            symbol = self.last[rows[open_]]
            rows[open_] = self.before[symbol] + self.tree.rank(symbol, rows[open_])
            steps[open_] += 1
            open_ = open_[~self.kept[rows[open_]]]
        return self.source[self.position[self.kept_rank[rows]] + steps]


@dataclass
class Phrases:
    """The distinct windows of a block of items, and the items of each."""

    vocabulary: np.ndarray  # sorted word hashes; symbol i + 1 is word i
    maybe: np.ndarray  # by the highest 16 bits: whether any word of the vocabulary has them
    symbols: np.ndarray
    length: np.ndarray
    item_first: np.ndarray
    items: np.ndarray


def compile_phrases(texts: pa.Array, ids: np.ndarray, window: int) -> Phrases:
    words = words_of(texts, ALNUM_LOWER)
    vocabulary, symbol = np.unique(words.hashes, return_inverse=True)
    n = np.diff(words.first)
    count = np.where(n >= window, n - window + 1, (n > 0).astype(n.dtype))
    owner = np.repeat(np.arange(len(n)), count)
    start = words.first[:-1][owner] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(n, window)[owner]
    columns = np.arange(window)
    inside = columns < length[:, None]
    table = np.zeros((len(owner), window), np.int32)
    table[inside] = symbol[(start[:, None] + columns)[inside]] + 1
    distinct, which = np.unique(table, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), ids[owner]]), axis=1) if len(owner) else np.zeros((2, 0), np.int64)
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    first = np.searchsorted(pairs[0], np.arange(len(distinct) + 1))
    return Phrases(vocabulary, maybe, distinct, (distinct > 0).sum(axis=1), first, pairs[1])


def _symbols(hashes: np.ndarray, phrases: Phrases) -> np.ndarray:
    """Symbols of document words, 0 for words that no item has."""
    out = np.zeros(len(hashes), np.int64)
    at = np.flatnonzero(phrases.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
    slot = np.searchsorted(phrases.vocabulary, hashes[at])
    slot[slot == len(phrases.vocabulary)] = 0
    same = phrases.vocabulary[slot] == hashes[at]
    out[at[same]] = slot[same] + 1
    return out


def scan(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, ...]:
    """Words of each document; merged spans (document, start, end, in words); (document, item) pairs."""
    words = words_of(texts, ALNUM_LOWER)
    n = np.diff(words.first)
    none = np.zeros(0, np.int64)
    if not len(phrases.length) or not len(words.hashes):
        return n, none, none, none, none, none
    symbol = _symbols(words.hashes, phrases)
    document = words.document()
    # A phrase lies inside a run of benchmark words of one document, so runs shorter
    # than the shortest phrase stay out of the index.
    held = symbol > 0
    begin = held.copy()
    begin[1:] &= ~held[:-1] | (document[1:] != document[:-1])
    run = np.cumsum(begin) - 1
    size = np.bincount(run[held], minlength=int(begin.sum()))
    keep = held & (size[np.maximum(run, 0)] >= phrases.length.min()) if len(size) else held
    place = np.flatnonzero(keep)
    if not len(place):
        return n, none, none, none, none, none
    run_end = np.append(run[place][1:] != run[place][:-1], True)
    index = FMIndex(symbol[place], run_end, len(phrases.vocabulary))
    low, high = index.search(phrases.symbols, phrases.length)
    many = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(many)), many)
    rows = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
    start = place[index.locate(rows)]
    # merged spans: where coverage goes from none to some and back; a document's end always ends one
    change = np.bincount(start, minlength=len(symbol) + 1) - np.bincount(
        start + phrases.length[phrase], minlength=len(symbol) + 1
    )
    covered = np.cumsum(change)[:-1] > 0
    opens, closes = covered.copy(), covered.copy()
    opens[1:] &= ~covered[:-1] | (document[1:] != document[:-1])
    closes[:-1] &= ~covered[1:] | (document[1:] != document[:-1])
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    of = document[a]
    # items of the phrases found
    found = np.unique(np.stack([document[start], phrase]), axis=1)
    per = np.diff(phrases.item_first)[found[1]]
    inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    items = phrases.items[np.repeat(phrases.item_first[found[1]], per) + inner]
    pairs = np.unique(np.stack([np.repeat(found[0], per), items]), axis=1)
    base = words.first[of]
    return n, of, a - base, b - base, pairs[0], pairs[1]


def _offsets(owner: np.ndarray, rows: int) -> pa.Array:
    return pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32))


def _put_together(parts: list[DataFrame], key: str) -> DataFrame:
    """One row for each document again, of the rows that the blocks of phrases gave."""
    rows = parts[0].withColumn("copies", F.lit(1))
    for part in parts[1:]:
        rows = rows.unionByName(part.withColumn("copies", F.lit(0)))
    met = rows.groupBy(key, "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sum("copies").cast("int").alias("copies"),
    )

    def join(done: Column, s: Column) -> Column:
        tail = F.element_at(done, -1)
        longer = F.named_struct(F.lit("start"), tail["start"], F.lit("end"), F.greatest(tail["end"], s["end"]))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), grown).otherwise(
            F.concat(done, F.array(s))
        )

    merged = F.aggregate("spans", F.array().cast(_SPANS), join)
    # documents that are the same in key and text had met in one row
    return met.select(
        key, "n_words", merged.alias("spans"), "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")
    ).drop("copy")


_SPANS = "array<struct<start:int,end:int>>"
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    key: str = "doc_id",
    item: str = "item_id",
) -> DataFrame:
    """Where benchmark passages stand in the documents.

    Returns ``key``, ``n_words``, ``spans`` (merged, in words, end exclusive) and
    ``items`` (distinct ids, in order). A passage is ``window`` consecutive words of an item,
    or all words of a shorter one. A null or empty text has no words; items without id or words find
    nothing; with no items nothing is hit; repeated documents are judged each on their own, repeated items count once. One pass
    over the documents, no shuffle: each few megabytes of text are a shard with an FM-index of its own,
    searched for all phrases. The phrases are broadcast in blocks of ``BLOCK_BYTES``
    of benchmark text; only if there are several, their spans are put together by a shuffle.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).where(
        "item is not null and text is not null"
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(_SPAN)),
            T.StructField("items", T.ArrayType(T.LongType())),
        ]
    )

    def one(block: int, more: Column | None = None) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow().combine_chunks()
        texts = pa.array(rows["text"].to_pylist(), pa.string())
        sent = spark.sparkContext.broadcast(
            compile_phrases(texts, rows["item"].to_numpy().astype(np.int64), window)
        )

        extra = [] if more is None else [more.alias("text_hash")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "text"):
                n, of, a, b, with_item, found = scan(piece.column(1), sent.value)
                pairs = pa.StructArray.from_arrays(
                    [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["start", "end"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(_offsets(of, len(n)), pairs),
                        pa.ListArray.from_arrays(_offsets(with_item, len(n)), pa.array(found.astype(np.int64))),
                        *piece.columns[2:],
                    ],
                    [key, "n_words", "spans", "items", *piece.schema.names[2:]],
                )

        return docs.select(F.col(key), F.col(text).alias("text"), *extra).mapInArrow(
            run, T.StructType([*schema, *[T.StructField("text_hash", T.LongType()) for _ in extra]])
        )

    if blocks == 1:
        return one(0)
    return _put_together([one(b, F.xxhash64(text)) for b in range(blocks)], key)


def words_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least a twentieth of the words, and one, stand in benchmark passages."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
