"""Language of texts: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.words import pieces, text_bytes

#: Hashed byte pairs and triples of a text.
CELLS = 1024
#: Rows of each language that the machines are fitted on, those of the smallest hash. (Up to 1,000 Spark
#: ranks inside each partition first, so a language with most rows gathers nowhere.)
ROWS_PER_LANGUAGE = 1000
UNKNOWN = "und"

# Languages of the larger families; any other language is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
_FAMILY_OF = {language: family for family, members in FAMILIES.items() for language in members}

_LETTER = regex.compile(r"\p{L}")


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.split("-")[0].lower(), language)


def profiles(texts: pa.Array) -> np.ndarray:
    """Of each text: roots of the shares of its hashed byte pairs and triples, lower-cased (A-Z)."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    low = data.astype(np.int64)
    low[(low >= 65) & (low <= 90)] += 32
    out = np.zeros((n, CELLS))
    for size in (2, 3):
        code = np.zeros(max(0, len(low) - size + 1), np.int64)
        for i in range(size):
            code = code * 256 + low[i : len(low) - size + 1 + i]
        cell = ((code * 0x9E3779B1 + size * 0x85EBCA6B) >> 12) % CELLS
        count = np.maximum(np.diff(offsets) - size + 1, 0)
        place = np.arange(count.sum()) + np.repeat(offsets[:-1] - (np.cumsum(count) - count), count)
        owner = np.repeat(np.arange(n), count)
        out += np.bincount(owner * CELLS + cell[place], minlength=n * CELLS).reshape(n, CELLS)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


@dataclass
class Chooser:
    """One-versus-one machines over some names; every machine votes for one of its two."""

    names: list[str]
    weights: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The name with most votes (ties: larger margins, then the earlier name), and how sure its votes are."""
        votes = np.zeros((len(x), len(self.names)))
        sure = np.zeros_like(votes)
        for (a, b), w in self.weights.items():
            chance = 1 / (1 + np.exp(-np.clip(2 * (x @ w[1:] + w[0]), -30, 30)))
            votes[:, a] += chance < 0.5
            votes[:, b] += chance >= 0.5
            sure[:, a] += 1 - chance
            sure[:, b] += chance
        best = (votes * 4 * len(self.names) + sure).argmax(axis=1)
        machines = max(1, len(self.names) - 1)
        return best, sure[np.arange(len(x)), best] / machines if self.weights else np.ones(len(x))


@dataclass
class Model:
    families: Chooser
    members: list[Chooser]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and certainty of each text; ``UNKNOWN`` and 0 where there is no letter."""
        readable = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.families.names or not readable.any():
            return names, score
        x = profiles(texts)
        family, sure = self.families.choose(x)
        for f, chooser in enumerate(self.members):
            rows = np.flatnonzero(readable & (family == f))
            if len(rows):
                best, inner = chooser.choose(x[rows])
                score[rows] = sure[rows] * inner
                for i, b in zip(rows.tolist(), best.tolist()):
                    names[i] = chooser.names[b]
        return names, score


def _machines(rows: DataFrame, names: list[str], column: str) -> Chooser:
    chooser = Chooser(names)
    for a, b in combinations(range(len(names)), 2):
        two = rows.where(F.col(column).isin(names[a], names[b]))
        two = two.select("features", (F.col(column) == names[b]).cast("double").alias("label"))
        fitted = LinearSVC(maxIter=30, regParam=1e-4, standardization=False).fit(two)
        chooser.weights[a, b] = np.append(fitted.intercept, fitted.coefficients.toArray())
    return chooser


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        x = profiles(piece.column(0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * CELLS), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([piece.column(1), lists], ["lang", "profile"])


def fit(labelled: DataFrame) -> Model:
    """Fits the machines on a bounded sample of rows (``id``, ``text``, ``lang``) with language and letters."""
    known = labelled.where("lang is not null and text is not null").select("id", "lang", F.xxhash64("id").alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "id")
    chosen = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ROWS_PER_LANGUAGE)
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    families = sorted({family_of(x) for x in languages})
    to_family = F.create_map(*[F.lit(x) for name in languages for x in (name, family_of(name))]) if languages else None
    if to_family is None:
        return Model(Chooser([]), [])
    sample = labelled.join(F.broadcast(chosen.select("id", "lang")), ["id", "lang"])
    rows = (
        sample.select("text", "lang")
        .mapInArrow(_featured, "lang string, profile array<double>")
        .select(array_to_vector("profile").alias("features"), "lang", to_family[F.col("lang")].alias("family"))
        .persist()
    )
    members = [[x for x in languages if family_of(x) == f] for f in families]
    model = Model(
        _machines(rows, families, "family"),
        [_machines(rows.where(F.col("family") == f), names, "lang") for f, names in zip(families, members)],
    )
    rows.unpersist()
    return model


def predict_languages(
    df: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", lang: str = "lang"
) -> DataFrame:
    """Language of every text: ``key``, ``lang_pred`` and ``score`` from 0 to 1.

    Learns from the texts and languages of the rows for which ``learn`` holds, at most
    ``ROWS_PER_LANGUAGE`` of each language; a prediction looks at the text alone. Null texts and
    texts without a letter are ``und`` with score 0, as all are if nothing can be learned.
    Null keys and repeated rows are predicted like others. Families, and the languages inside each, are told
    apart by one-versus-one linear support vector machines over hashed byte pairs and triples.
    """
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), learn.alias("learn"))
    sent = df.sparkSession.sparkContext.broadcast(fit(docs.where("learn")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            names, score = sent.value.predict(piece.column(1))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(names), pa.array(score)], [key, "lang_pred", "score"]
            )

    schema = f"`{key}` {dict(df.dtypes)[key]}, lang_pred string, score double"
    return docs.select("id", "text").mapInArrow(run, schema)
