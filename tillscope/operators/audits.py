"""Loss-prevention audits: severity, cashiers, produce weights, margin leakage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope import schema
from tillscope.functions import exprs as X
from tillscope.functions.lookup import attach, attach_per_period
from tillscope.functions.quantiles import (
    counted_quantiles,
    group_quantiles,
    median,
    nearest,
    value_counts,
)
from tillscope.operators.baskets import ensure_cashier
from tillscope.session import stage

# Quantiles below which a score is critical or a warning.
CRITICAL_QUANTILE = 0.01
WARNING_QUANTILE = 0.05
# Peers need two receipts; flagged above this z-score.
MIN_CASHIER_RECEIPTS = 2
CASHIER_Z_LIMIT = 1.5
ZERO_STD = 0.001
# Consistency constant and limit of the modified z-score.
MAD_SCALE = 1.4826
MAD_LIMIT = 6.0
PRODUCE_LABEL = "Peso/Prezzo Errante"
# Receipts needed for a fingerprint, risk weights, report limit.
FINGERPRINT_RECEIPTS = 10
RISK_WEIGHTS = {
    "avg_transaction_value": 0.1,
    "void_rate_per_receipt": 0.4,
    "abort_rate": 0.2,
    "cash_reliance_ratio": 0.3,
}
RISK_LIMIT = 0.5


def severity(scored: DataFrame) -> DataFrame:
    """Adds ``severity`` from the period's 1 % and 5 % quantiles of ``anomaly_score``."""
    limits = group_quantiles(
        scored,
        ["period"],
        "anomaly_score",
        {"_critical": nearest(CRITICAL_QUANTILE), "_warning": nearest(WARNING_QUANTILE)},
    ).drop("n")
    # left, so that a period without any score keeps its rows
    joined = attach_per_period(scored, limits, "left")
    score = F.col("anomaly_score")
    return joined.withColumn(
        "severity",
        F.when(score <= F.col("_critical"), "critical")
        .when(score <= F.col("_warning"), "warning")
        .when(score.isNotNull(), "info"),
    ).drop("_critical", "_warning")


def cashier_discount_scores(baskets: DataFrame) -> DataFrame:
    """Per cashier, the z-score of the mean discount ratio among the peers.

    Cashiers with fewer than two receipts are no peers; with fewer than two
    peers in the period every score is zero.
    """
    rates = (
        ensure_cashier(baskets)
        .groupBy("period", "cashier_id")
        .agg(
            F.avg(F.coalesce(F.col("discount_ratio"), F.lit(0.0))).alias("avg_discount_rate"),
            F.count(F.lit(1)).alias("transaction_count"),
        )
        .where(F.col("transaction_count") >= MIN_CASHIER_RECEIPTS)
    )
    rates = stage(rates, "cashier-rates")
    peers = rates.groupBy("period").agg(
        F.count(F.lit(1)).alias("_peers"),
        F.avg("avg_discount_rate").alias("_mean"),
        F.stddev_samp("avg_discount_rate").alias("_std"),
    )
    spread = F.when(F.col("_std") == 0, ZERO_STD).otherwise(F.coalesce(F.col("_std"), F.lit(ZERO_STD)))
    z = F.when(
        F.col("_peers") >= 2, (F.col("avg_discount_rate") - F.col("_mean")) / spread
    ).otherwise(0.0)
    return (
        attach_per_period(rates, peers)
        .withColumn("cashier_sweethearting_z_score", z)
        .withColumn(
            "cashier_sweethearting_anomaly_score",
            F.when(F.col("cashier_sweethearting_z_score") > CASHIER_Z_LIMIT, -1)
            .otherwise(0)
            .cast("byte"),
        )
        .drop("_peers", "_mean", "_std")
    )


def tag_cashier_sweethearting(baskets: DataFrame) -> DataFrame:
    """Adds the cashier's z-score and flag to each receipt (0 where there is none).

    ``baskets`` is read twice, so callers pass a staged table.
    """
    scores = cashier_discount_scores(baskets).where(F.col("cashier_id").isNotNull())
    scores = scores.select(
        "period", "cashier_id", "cashier_sweethearting_z_score", "cashier_sweethearting_anomaly_score"
    )
    return attach(ensure_cashier(baskets), scores, ["period", "cashier_id"]).withColumns(
        {
            "cashier_sweethearting_z_score": F.coalesce(
                F.col("cashier_sweethearting_z_score"), F.lit(0.0)
            ),
            "cashier_sweethearting_anomaly_score": F.coalesce(
                F.col("cashier_sweethearting_anomaly_score"), F.lit(0).cast("byte")
            ),
        }
    )


def cashier_alerts(baskets: DataFrame) -> DataFrame:
    """The flagged cashiers, once each; needs no join back to the receipts."""
    flag, z = "cashier_sweethearting_anomaly_score", "cashier_sweethearting_z_score"
    scores = cashier_discount_scores(baskets).where(F.col("cashier_id").isNotNull())
    return scores.select("period", "cashier_id", flag, z).where(
        (F.col(flag) == -1) | (F.col(z) > CASHIER_Z_LIMIT)
    )


def produce_weighing_errors(lines: DataFrame) -> DataFrame:
    """Weighed lines whose unit price is far from the product's median, by MAD."""
    keys = ["period", "product_id"]
    weight, total = (X.finite_or(F.col(c), None) for c in ("weight", "line_total"))
    weighed = lines.where((weight > 0) & (total > 0)).withColumn("unit_price", total / weight)
    # distinct prices with their counts serve both medians
    prices = stage(value_counts(weighed, keys, "unit_price"), "unit-prices")
    centers = counted_quantiles(prices, keys, {"med_price": median()}).drop("n")
    centers = stage(centers, "median-prices")
    deviations = attach(prices, centers, keys, staged=True).withColumn(
        "_d", F.abs(F.col("_v") - F.col("med_price"))
    )
    mads = group_quantiles(deviations, keys, "_d", {"mad_price": median()}, count="_c")
    spread = mads.where(F.col("mad_price") > 0).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "mad_price"
    )
    limits = centers.join(
        spread,
        centers["period"].eqNullSafe(F.col("_k_period"))
        & centers["product_id"].eqNullSafe(F.col("_k_product_id")),
    ).select(*keys, "med_price", "mad_price")
    distance = F.abs(F.col("unit_price") - F.col("med_price"))
    return (
        attach(weighed, limits, keys, how="inner")
        .where(distance / (F.col("mad_price") * MAD_SCALE) > MAD_LIMIT)
        .select(
            "period",
            "date_str",
            "receipt_id",
            F.col("product_id").alias("scontrinoBarcode"),
            F.lit(PRODUCE_LABEL).alias("scontrinoTipo"),
            "store_id",
        )
    )


def cashier_receipts(lines: DataFrame) -> DataFrame:
    """One row per cashier and receipt: value, voids, discounts, abort, payment.

    The payment code is that of the earliest line that has one. Grouping by the header
    columns first keeps the pass over the lines a hash aggregation.
    """
    header = ("date_str", "time_str", "payment_method_code")
    parts = lines.groupBy("period", "cashier_id", "receipt_id", *header).agg(
        F.sum("line_total").alias("value"),
        F.sum(F.col("is_item_void").cast("int")).alias("voids"),
        F.max(F.col("is_abort").cast("int")).alias("aborted"),
    )
    return parts.groupBy("period", "cashier_id", "receipt_id").agg(
        X.as_double(F.coalesce(F.sum("value"), F.lit(0))).alias("receipt_value"),
        F.coalesce(F.sum("voids"), F.lit(0)).alias("void_items_count"),
        F.coalesce(F.max("aborted"), F.lit(0)).alias("was_aborted"),
        X.earliest(F.col("payment_method_code"), F.col("date_str"), F.col("time_str")).alias("pay_code"),
    )


def cashier_fingerprint(lines: DataFrame) -> DataFrame:
    """Behaviour of each cashier with more than ten receipts."""
    receipts = cashier_receipts(lines)
    count = F.count(F.lit(1))
    return (
        receipts.groupBy("period", "cashier_id")
        .agg(
            count.alias("total_transactions"),
            F.avg("receipt_value").alias("avg_transaction_value"),
            X.ratio(F.sum("void_items_count"), count).alias("void_rate_per_receipt"),
            X.ratio(F.sum("was_aborted"), count).alias("abort_rate"),
            X.ratio(F.count_if(F.col("pay_code") == schema.CASH_CODE), count).alias(
                "cash_reliance_ratio"
            ),
        )
        .where(F.col("total_transactions") > FINGERPRINT_RECEIPTS)
    )


def behavioral_risk(fingerprints: DataFrame) -> DataFrame:
    """Adds ``risk_score``: weighted distances from the period's mean behaviour."""
    fingerprints = stage(fingerprints, "fingerprints")
    moments = []
    for feature in RISK_WEIGHTS:
        moments += [
            F.avg(feature).alias(f"_{feature}_mean"),
            F.stddev_samp(feature).alias(f"_{feature}_std"),
        ]
    stats = fingerprints.groupBy("period").agg(*moments)
    # a period with one cashier has no deviation and adds nothing to the score
    terms = [
        F.coalesce(
            F.abs((F.col(f) - F.col(f"_{f}_mean")) / (F.col(f"_{f}_std") + X.EPSILON)) * weight,
            F.lit(0.0),
        )
        for f, weight in RISK_WEIGHTS.items()
    ]
    scored = attach_per_period(fingerprints, stats).withColumn(
        "risk_score", reduce(lambda a, b: a + b, terms)
    )
    helpers = [f"_{f}_{part}" for f in RISK_WEIGHTS for part in ("mean", "std")]
    return scored.drop(*helpers)


def risk_report(risks: DataFrame) -> DataFrame:
    """Cashiers above the risk limit, rounded for the report, highest first."""
    return (
        risks.where(F.col("risk_score") > RISK_LIMIT)
        .select(
            "period",
            "cashier_id",
            F.round("risk_score", 2).alias("risk_score"),
            F.round("cash_reliance_ratio", 3).alias("cash_reliance_ratio"),
            F.round("void_rate_per_receipt", 3).alias("void_rate_per_receipt"),
        )
        .orderBy("period", F.desc("risk_score"), "cashier_id")
    )


def margin_leakage(lines: DataFrame) -> DataFrame:
    """Discounts, voids and revenue per cashier; the share is null without revenue."""
    return (
        lines.groupBy("period", "cashier_id")
        .agg(
            X.as_double(F.coalesce(F.sum("total_discounts"), F.lit(0))).alias("total_markdowns"),
            F.coalesce(F.sum(F.col("is_item_void").cast("int")), F.lit(0)).alias("total_voids"),
            X.as_double(F.coalesce(F.sum("line_total"), F.lit(0))).alias("captured_revenue"),
        )
        .withColumn("leakage_pct", X.ratio(F.col("total_markdowns"), F.col("captured_revenue")))
    )
