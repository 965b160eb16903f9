"""Receipt lines out of the order and line item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALL = "ALL"


def raw_receipt_lines(
    spark: SparkSession, sf_dir: str, period: Column | None = None, wanted: Column | None = None
) -> DataFrame:
    """``lineitem`` joined with ``orders``, in the raw point-of-sale columns.

    ``period`` may use the order columns; by default there is one period. ``wanted``
    picks orders, before the join. Both tables grow together, so the join is left to a shuffle on the order key.
    """
    period = F.lit(ALL) if period is None else period
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda c, width: F.lpad(c.cast("string"), width, "0")
    # what belongs to the receipt is worked out once per order, before the join
    picked = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders = (picked if wanted is None else picked.where(wanted)).select(
        "o_orderkey",
        F.concat(F.lit("S"), (customer % 10).cast("string")).alias("negozioCodice"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("scontrinoData"),
        F.concat(text(8 + key % 13, 2), F.lit(":"), text(key * 7 % 60, 2)).alias("scontrinoOra"),
        F.concat(F.lit("C"), text(customer % 50, 2)).alias("cassiereCodice"),
        F.lpad(F.substring("o_orderpriority", 1, 1), 2, "0").alias("formaPagamentoCodice"),
        F.when(key % 3 == 0, "Y").otherwise("N").alias("selfScanning"),
        F.when(key % 40 == 0, "S").otherwise("N").alias("abortito"),
        period.cast("string").alias("period"),
    )
    # and what belongs to the line in few bytes: cents and flags shrink more in the shuffle than doubles and codes
    price = F.col("l_extendedprice").cast("decimal(8,2)")
    voided = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey",
        "l_partkey",
        price.alias("totaleLordo"),
        F.when(F.col("l_partkey") % 4 == 0, F.col("l_quantity")).alias("quantitaPeso"),
        (price * F.col("l_discount").cast("decimal(4,2)")).alias("totaleSconti"),
        F.coalesce(voided, F.lit(False)).alias("voided"),
        F.coalesce(F.col("l_discount") == 0, F.lit(False)).alias("given"),
    )
    return items.join(orders.hint("merge"), F.col("l_orderkey") == key).select(
        F.col("l_orderkey").cast("string").alias("scontrinoIdentificativo"),
        F.col("l_partkey").cast("string").alias("articoloCodice"),
        "totaleLordo",
        "quantitaPeso",
        "totaleSconti",
        F.lit(0).alias("puntiRitiro"),
        F.when(F.col("voided"), "y").otherwise("N").alias("storno"),
        F.lit("N").alias("annullo"),
        F.when(F.col("given"), "1").otherwise("0").alias("omaggio"),
        *[c for c in orders.columns if c != "o_orderkey"],
    )


def order_year() -> Column:
    return F.year("o_orderdate")
