"""The corpus pipeline: cleans the documents stage by stage and encodes what is left.

Every stage reads all that the one before kept and works on whole texts. A document
without id is kept by the stages that need one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm import bpe, decontaminate, jaccard, secret_scan, toxicity
from tillscope.session import scratch_dir, ship_package, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents of at least this toxicity go.
TOXIC = 0.3
_SPANS, _ROW, _PLACE = "spans of secrets", "row of text", "place in row of text"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class models, fitted on three quarters of the labels, don't call toxic."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = toxicity.bucket(F.col("doc_id"), 4) != 2
    return toxicity.with_scores(docs, labels, learn).where(F.col("score") < TOXIC).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id; texts without words link with none.

    Rows of one id with different texts are different documents, the order of their hashes decides between them. Of
    rows that are equal in id and text one stays, the first by the other columns. Rows without id stay.
    """
    ship_package(spark)
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("hash")))
    keyed = docs.withColumn(_ROW, own)
    linked = jaccard.link_documents(keyed.select(_ROW, "text"), k=5, percent=80, key=_ROW)
    stays = F.max(F.col("component_id").eqNullSafe(F.col(_ROW)))
    told = linked.where(F.col(_ROW).isNotNull()).groupBy(_ROW).agg(stays.alias("stays"), F.count("*").alias("rows"))
    told = stage(told.where("not stays or rows > 1"), "told")
    single = jaccard.only(keyed, told.select(_ROW), _ROW, how="left_anti", width=4)
    several = jaccard.only(keyed, told.where("stays").select(_ROW), _ROW, width=4)
    place = F.row_number().over(Window.partitionBy(_ROW).orderBy(*docs.columns))
    first = several.withColumn(_PLACE, place).where(F.col(_PLACE) == 1)
    return single.select(*docs.columns).unionByName(first.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than a twentieth stand in benchmark passages; every row is judged by itself."""
    ship_package(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(F.struct(*docs.columns).alias(_ROW), "text")
    found = decontaminate.find_passages(rows, benchmark, key=_ROW)
    n_hit = decontaminate.words_hit(F.col("spans"))
    clean = found.where(~decontaminate.is_contaminated(F.col("n_words"), n_hit))
    return clean.select(*[F.col(_ROW)[c].alias(c) for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mask; others are unchanged."""
    spans = F.col(_SPANS)
    text = F.when(F.size(spans) > 0, secret_scan.masked(F.col("text"), spans)).otherwise(F.col("text"))
    length = F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    marked = secret_scan.with_spans(docs, spans=_SPANS)
    return marked.withColumn("text", text).withColumn("n_chars", length).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the bytes they decode to."""
    ship_package(spark)
    return bpe.encode_decode(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: Fitted language models and vocabulary files are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents; each but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, step in STAGES[:-1]:
        step(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
