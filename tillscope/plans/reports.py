"""The three reports and the bulk audit, as tables and as files."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope import schema

# What the sections of each report hold, written into its metadata.
DICTIONARY = {
    "missions": "Ricavi e traffico di ogni missione di spesa, per periodo.",
    "integrity": "Cassieri con sconti anomali e pesate con prezzo unitario anomalo, per periodo.",
    "behavior": "Profilo di rischio dei cassieri e perdita di margine, per periodo.",
}


def _renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnRenamed("period", "periodo").withColumnsRenamed(names)


def mission_report(insights: DataFrame) -> DataFrame:
    """Mission KPIs with Italian labels and field names."""
    pairs = [F.lit(text) for pair in schema.MISSION_LABELS.items() for text in pair]
    label = F.create_map(*pairs)[F.col("shopping_mission")]
    labelled = insights.withColumn("shopping_mission", F.coalesce(label, F.col("shopping_mission")))
    return _renamed(labelled, schema.MISSION_REPORT_NAMES)


def integrity_report(alerts: DataFrame) -> DataFrame:
    return _renamed(alerts, schema.INTEGRITY_REPORT_NAMES)


def behavior_report(rows: DataFrame) -> DataFrame:
    """Field names for the risk rows as well as for the leakage rows."""
    return _renamed(rows, schema.BEHAVIOR_REPORT_NAMES)


def write_report(
    path: str,
    title: str,
    description: str,
    sections: Mapping[str, DataFrame],
    records: str = "dettagli",
    as_lines: Collection[str] = (),
) -> None:
    """Writes one report folder, in the same form at every size.

    ``report`` holds one nested document: metadata, then each section as a list
    of {periodo, records}. Sections named in ``as_lines``, those that grow with
    the data, go to ``<section>/periodo=...`` as JSON lines, and the document
    names that folder. The other sections have a few rows for each period and
    mission, or one for each cashier.
    """
    spark = next(iter(sections.values())).sparkSession
    fields = {f: f for df in sections.values() for f in df.columns}
    notes = [F.lit(x) for f in fields for x in (f, schema.FIELD_NOTES.get(f, f))]
    metadata = F.struct(
        F.lit(title).alias("titolo"),
        F.lit(description).alias("descrizione"),
        F.create_map(*notes).alias("dizionario_dati"),
    )
    document = spark.range(1).select("id", metadata.alias("metadata"))
    for name, section in sections.items():
        df = section
        if name in as_lines:
            df.write.mode("overwrite").partitionBy("periodo").json(f"{path}/{name}")
            document = document.withColumn(name, F.lit(f"{name}/"))
            continue
        columns = [F.col(f"`{c}`") for c in df.columns if c != "periodo"]
        periods = df.groupBy("periodo").agg(F.collect_list(F.struct(*columns)).alias(records))
        listed = periods.agg(
            F.sort_array(F.collect_list(F.struct("periodo", records))).alias(name)
        ).withColumn("id", F.lit(0).cast("long"))
        document = document.join(listed, "id", "left")
    document.drop("id").coalesce(1).write.mode("overwrite").json(f"{path}/report")


def period_documents(title: str, description: str, sections: Mapping[str, DataFrame]) -> DataFrame:
    """One nested document per period: ``periodo``, ``metadata`` and a list of records for each section.

    The metadata explain every field of the sections (``schema.FIELD_NOTES``). A section without rows in a period is an
    empty list. Sections have a few rows for each period and mission, or one for each cashier.
    """
    fields = ["periodo", *dict.fromkeys(c for df in sections.values() for c in df.columns if c != "periodo")]
    notes = F.create_map(*[F.lit(x) for f in fields for x in (f, schema.FIELD_NOTES[f])])
    metadata = F.struct(
        F.lit(title).alias("titolo"), F.lit(description).alias("descrizione"), notes.alias("dizionario_dati")
    )
    # every record goes to its period under the name of its section; other sections are null there
    parts = []
    for name, df in sections.items():
        record = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "periodo"])
        parts.append(df.select("periodo", record.alias(name)))
    records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    lists = [F.sort_array(F.collect_list(name)).alias(name) for name in sections]
    return records.groupBy("periodo").agg(*lists).withColumn("metadata", metadata).select("periodo", "metadata", *sections)


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per line, in a folder per period."""
    folder = F.coalesce("periodo", F.lit("none"))
    documents.withColumn("folder", folder).write.mode("overwrite").partitionBy("folder").json(path)


def read_documents(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The documents below ``path``, parsed with the schema of ``like``."""
    lines = spark.read.text(path).select("value")
    return lines.select(F.from_json("value", like.schema).alias("d")).select("d.*")


def write_bulk_audit(audit: DataFrame, path: str) -> None:
    """Bulk receipts as CSV with a header, one folder per period."""
    audit.write.mode("overwrite").option("header", True).partitionBy("period").csv(path)
