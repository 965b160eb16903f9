"""Toxic documents by class-conditional Kneser-Ney models of word pieces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.words import ALNUM_LOWER, Words, pieces, signed, window_hashes, words_of

#: Bytes of an expression: a piece of a word, its begin and end marked, that the models count.
#: A long one that too few labelled rows have backs off to the short one at the same place.
GRAM, LONG_GRAM = 5, 8
LEAST_ROWS = 2
#: Labelled rows that the class models and the calibration use, of each class.
ROWS_PER_CLASS = 20_000
#: One labelled row in so many calibrates; the others are counted.
CALIBRATE = 4
DISCOUNT = 0.75
FEATURES = ["worst_short", "worst", "mean"]


def bucket(key: Column, n: int) -> Column:
    """The remainder of the key's checksum, by which rows are held out."""
    return F.crc32(key.cast("string")) % n


def word_grams(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The expressions of some words, one word after the other.

    Gives the short ones, where each word's begin among them, the long ones, and the
    short ones in whose place these stand.
    """
    length = words.end[which] - words.start[which] + 2
    edge = np.concatenate([[0], np.cumsum(length)])
    marked = np.full(edge[-1], 1, np.uint64)
    inner = np.ones(edge[-1], bool)
    inner[edge[:-1]] = inner[edge[1:] - 1] = False
    source = np.arange(edge[-1]) + np.repeat(words.start[which] - 1 - edge[:-1], length)
    marked[inner] = ALNUM_LOWER[words.data[source[inner]]]
    count = np.maximum(length - GRAM + 1, 1)
    first = np.cumsum(count) - count
    within = np.arange(count.sum()) - np.repeat(first, count)
    start = within + np.repeat(edge[:-1], count)
    size = np.repeat(length, count)
    place = np.flatnonzero(within + LONG_GRAM <= size)
    short = window_hashes(marked, start, np.minimum(size, GRAM))
    return short, first, window_hashes(marked, start[place], LONG_GRAM), place


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values stand in a sorted table, and which do."""
    slot = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return slot, table[slot] == values


@dataclass
class Model:
    """Log-likelihood ratios of expressions, sorted by hash, and the calibration of scores."""

    grams: np.ndarray
    ratio: np.ndarray
    unseen: float
    weights: np.ndarray | None = None

    def features(self, texts: pa.Array) -> np.ndarray:
        """Of each text: the most toxic short expression, the most toxic of any length, and the mean.

        All compare the toxic and the ordinary log-likelihood, divided by length: over two
        neighbouring grams of a word, and over the whole text.
        """
        words = words_of(texts, ALNUM_LOWER)
        out = np.zeros((len(words.first) - 1, 3))
        if not len(words.hashes) or not len(self.grams):
            return out
        _, which, of = np.unique(words.hashes, return_index=True, return_inverse=True)
        grams, first, long, place = word_grams(words, which)
        slot, known = _find(self.grams, grams)
        value = np.where(known, self.ratio[slot], self.unseen)
        count = np.diff(np.append(first, len(grams)))
        last = first[count > 1] + count[count > 1] - 1
        full = np.flatnonzero(np.diff(words.first) > 0)
        begin = words.first[:-1][full]
        for column in (0, 1):
            pair = value.copy()
            pair[:-1] = (value[:-1] + value[1:]) / 2
            pair[last] = -np.inf  # the last gram of a word begins no pair
            worst = np.maximum.reduceat(pair, first)
            out[full, column] = np.maximum.reduceat(worst[of], begin)
            if column == 0:
                slot, known = _find(self.grams, long)
                value[place[known]] = self.ratio[slot[known]]
        total = np.add.reduceat(value, first)
        out[full, 2] = np.add.reduceat(total[of], begin) / np.add.reduceat(count[of], begin)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        z = self.weights[0] + features @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrated(features: np.ndarray, label: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method; ``rows`` says how many each row stands for."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, *[1e-2] * features.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (rows * p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(curve + ridge, x.T @ (rows * (label - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _chosen(labels: DataFrame, key: str, label: str, learn: Column) -> DataFrame:
    """Keys and labels of at most so many rows of each class, those of the smallest hash.

    ``stands_for`` is how many labelled rows of its class, over all rows, each one taken stands for.
    """
    rows = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & learn)
        .groupBy(F.col(key).alias("id"))
        .agg(F.max(label).alias("label"))
        .withColumn("h", F.xxhash64("id"))
    )
    count = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sides = [
        rows.where(F.col("label") == c)
        .orderBy("h", "id")
        .limit(ROWS_PER_CLASS)
        .withColumn("stands_for", F.lit(max(count.get(c, 0) / ROWS_PER_CLASS, 1.0)))
        for c in (0, 1)
    ]
    calibrates = (F.pmod("h", F.lit(CALIBRATE)) == 0).alias("calibrates")
    return sides[0].union(sides[1]).select("id", "label", "stands_for", calibrates)


def _class_counts(labelled: DataFrame) -> DataFrame:
    """In how many documents of each class an expression stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = words_of(piece.column(1), ALNUM_LOWER)
            label = piece.column(2).to_numpy()
            if not len(words.hashes):
                continue
            grams, first, long, place = word_grams(words, np.arange(len(words.hashes)))
            of = np.repeat(words.document(), np.diff(np.append(first, len(grams))))
            long_ones = np.append(np.zeros(len(grams), bool), np.ones(len(long), bool))
            grams, of = np.append(grams, long), np.append(of, of[place])
            order = np.lexsort((grams, of))
            long_ones = long_ones[order]
            grams, of = grams[order], of[order]
            keep = np.append(True, (grams[1:] != grams[:-1]) | (of[1:] != of[:-1]))
            grams, toxic = grams[keep], label[of[keep]]
            value, which, at = np.unique(grams, return_index=True, return_inverse=True)
            yes = np.bincount(at, toxic, len(value)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(value)),
                    pa.array(long_ones[keep][which]),
                    pa.array(yes),
                    pa.array(np.bincount(at, minlength=len(value)) - yes),
                ],
                ["gram", "long", "toxic", "ordinary"],
            )

    counted = labelled.select("id", "text", F.col("label").cast("long")).mapInArrow(
        run, "gram long, long boolean, toxic long, ordinary long"
    )
    total = counted.groupBy("gram", "long").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    return total.where((~F.col("long")) | (F.col("toxic") + F.col("ordinary") >= LEAST_ROWS))


def _distinct_words(docs: DataFrame) -> DataFrame:
    """Every distinct word of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = words_of(piece.column(0), ALNUM_LOWER)
            _, which = np.unique(words.hashes, return_index=True)
            data = ALNUM_LOWER[words.data].astype(np.uint8).tobytes()
            spelled = [data[a:b] for a, b in zip(words.start[which].tolist(), words.end[which].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(spelled, pa.binary())], ["word"])

    return docs.select("text").mapInArrow(run, "word binary").distinct()


def _contexts(docs: DataFrame, grams: np.ndarray) -> DataFrame:
    """In how many distinct words of the whole corpus each of the expressions stands."""
    sent = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column(0).cast(pa.string()), ALNUM_LOWER)
            if not len(words.hashes):
                continue
            found, first, long, place = word_grams(words, np.arange(len(words.hashes)))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(found))))
            of = np.append(of, of[place])
            slot, known = _find(sent.value, np.append(found, long))
            pairs = np.unique(of[known] * len(sent.value) + slot[known]) % len(sent.value)
            value, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["slot", "n"])

    return _distinct_words(docs).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", label: str = "toxic") -> Model:
    """Fits on ``docs`` (id, text) and on the labelled rows for which ``learn`` holds.

    The class counts come from a bounded sample of labelled rows (``ROWS_PER_CLASS`` of each class)
    and keep all their expressions; those grow with these rows' texts alone, so the model may be broadcast. Both classes share
    one backoff distribution, the continuation counts: in how many distinct words
    of all documents an expression stands. Calibrating rows count for all labelled rows of their
    class, so a score means the same whether or not the sample's bound is reached.
    """
    chosen = F.broadcast(_chosen(labels, key, label, learn))
    labelled = docs.join(chosen, "id")
    rows = _class_counts(labelled.where("not calibrates")).select("gram", "toxic", "ordinary").toArrow().combine_chunks()
    grams = rows["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    grams = grams[order]
    toxic, ordinary = rows["toxic"].to_numpy()[order], rows["ordinary"].to_numpy()[order]
    model = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    if not toxic.any() or not ordinary.any():
        return model  # one class only: nothing can be told apart
    rows = _contexts(docs, grams).toArrow()
    contexts = np.ones(len(grams))
    contexts[rows["slot"].to_numpy()] += rows["n"].to_numpy()
    shared = contexts / contexts.sum()
    side = {}
    for name, count in (("toxic", toxic), ("ordinary", ordinary)):
        total, kinds = count.sum(), np.count_nonzero(count)
        left = DISCOUNT * kinds / total
        side[name] = left, np.maximum(count - DISCOUNT, 0) / total + left * shared
    model = Model(
        grams,
        np.log(side["toxic"][1]) - np.log(side["ordinary"][1]),
        # an expression that no labelled row has backs off in both classes
        float(np.log(side["toxic"][0]) - np.log(side["ordinary"][0])),
    )
    held = labelled.where("calibrates").select("id", "text", "label", "stands_for")
    held = _scored(held, model, "label", "stands_for").toPandas()
    if held["label"].nunique() == 2:
        label = held["label"].to_numpy().astype(float)
        model.weights = calibrated(held[FEATURES].to_numpy(), label, held["stands_for"].to_numpy())
    else:
        # no row of one class to calibrate on: evidence of about 150 to 1 is even odds
        model.weights = np.array([-5.0, 1.0, 0.0, 0.0])
    return model


def _scored(docs: DataFrame, model: Model, *kept: str, inside: str | None = None) -> DataFrame:
    """``id``, further columns, and the features and the score of every text.

    With ``inside``, ``docs`` has one column, a struct, whose field of that name is the text, so texts are sent once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = ["id", *kept] if inside is None else docs.columns
    docs = docs.select(*columns, "text") if inside is None else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if inside is not None:
            batches = (
                pa.RecordBatch.from_arrays([b.column(0), pc.struct_field(b.column(0), inside)], [*columns, "text"])
                for b in batches
            )
        for piece in pieces(batches, "text"):
            features = sent.value.features(piece.column(piece.schema.get_field_index("text")))
            values = [*features.T, sent.value.score(features)]
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(piece.schema.get_field_index(c)) for c in columns], *map(pa.array, values)],
                [*columns, *FEATURES, "score"],
            )

    numbers = [T.StructField(c, T.DoubleType()) for c in [*FEATURES, "score"]]
    schema = T.StructType([docs.schema[c] for c in columns] + numbers)
    return docs.mapInArrow(run, schema)


def score_documents(
    df: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "toxic"
) -> DataFrame:
    """Toxicity of every text: ``key`` and ``score`` from 0 to 1, likelier toxic the higher.

    ``learn`` says which rows of ``labels`` (key, label 0 or 1) may be learned from. Labels that are null, other numbers or without key are left
    out; of several labels of a key the highest counts. Scores depend on the text only. A null or empty text scores
    as one without evidence; if all labels agree every score is 0. Repeated rows and null
    keys are scored like others.
    """
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    model = fit(docs, labels, learn, key, label)
    return _scored(docs, model).select(F.col("id").alias(key), "score")


def with_scores(
    df: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "toxic"
) -> DataFrame:
    """As ``score_documents``, with every whole row: ``row`` (a struct of its columns) and ``score``."""
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = df.select(F.struct(*df.columns).alias("row"))
    return _scored(rows, fit(docs, labels, learn, key, label), inside=text).select("row", "score")
