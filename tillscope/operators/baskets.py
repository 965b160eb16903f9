"""Receipt-level features and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope import schema
from tillscope.functions import exprs as X

# One receipt normally has one header; where lines disagree, each field is that of
# the earliest line that has it.
_HEADER = ("date_str", "time_str", "cashier_id", "store_id")
# What receipts lack whose lines have no price features.
PRICE_COLUMNS = (
    "discounted_item_count", "avg_basket_unit_price", "avg_price_delta_per_basket", "discount_ratio",
)


def _total(col: Column) -> Column:
    """Sum that is zero for no rows."""
    return F.coalesce(F.sum(col), F.lit(0))


def basket_features(lines: DataFrame) -> DataFrame:
    """One row per period and receipt with 17 aggregates and 7 ratios.

    Lines without the price features give receipts without the columns that need
    them (``PRICE_COLUMNS``), and then no product median is worked out. Grouping by
    the header columns first keeps every aggregation buffer fixed-width, so both
    steps hash-aggregate and the first one shrinks the lines before the shuffle.
    """
    priced = "avg_unit_price" in lines.columns
    total = F.col("line_total")
    weight = X.finite_or(F.col("weight"), 0.0)
    fresh = weight > 0
    void = F.col("is_item_void").cast("boolean")
    parts = lines.groupBy("period", "receipt_id", *_HEADER).agg(
        F.sum(total).alias("value"),
        F.count(F.lit(1)).alias("size"),
        F.sum(weight).alias("weight"),
        F.sum(F.when(fresh, weight)).alias("fresh_weight"),
        F.sum(F.when(fresh, total)).alias("fresh_value"),
        F.sum(fresh.cast("int")).alias("fresh_lines"),
        F.sum(F.col("is_item_void").cast("int")).alias("voids"),
        F.sum(F.when(void, total)).alias("void_value"),
        *(_price_parts() if priced else []),
    )
    # dealt before the second grouping: its buffers hold each header field with date and time, three times the row
    whole = parts.repartition("period", "receipt_id").groupBy("period", "receipt_id").agg(
        X.as_double(_total(F.col("value"))).alias("basket_value"),
        F.sum("size").alias("basket_size"),
        (_total(F.col("fresh_lines")) > 0).alias("has_fresh_produce"),
        X.as_double(_total(F.col("fresh_weight"))).alias("fresh_weight_sum"),
        X.as_double(_total(F.col("weight"))).alias("total_weight"),
        _total(F.col("voids")).alias("total_voids"),
        X.as_double(F.abs(_total(F.col("void_value")))).alias("void_value"),
        X.as_double(_total(F.col("fresh_value"))).alias("fresh_value_sum"),
        *(_price_totals() if priced else []),
        *[X.earliest(F.col(c), F.col("date_str"), F.col("time_str")).alias(c) for c in _HEADER],
    )
    day, hour = X.parse_day(F.col("date_str")), X.hour_prefix(F.col("time_str"))
    size, value = F.col("basket_size"), F.col("basket_value")
    receipts = whole.withColumns(
        {
            "hour_of_day": hour,
            "is_weekend": X.weekend_flag(day),
            "store_numeric": X.md5_bucket(F.col("store_id"), 1000),
            "peak_hour_pressure_numeric": X.peak_flag(hour),
            "is_single_item_flag": (size == 1).cast("byte"),
            "basket_value_per_item": X.fill_missing(X.ratio(value, size)),
            "void_rate_per_receipt": X.fill_missing(X.ratio(F.col("total_voids"), size)),
            "freshness_weight_ratio": X.fill_missing(
                X.ratio(F.col("fresh_weight_sum"), F.col("total_weight") + X.EPSILON)
            ),
            "freshness_value_ratio": X.fill_missing(
                X.ratio(F.col("fresh_value_sum"), value + X.EPSILON)
            ),
            "leakage_pct": X.fill_missing(
                X.ratio(F.col("void_value"), value + F.col("void_value") + X.EPSILON)
            ),
        }
    ).drop("date_str", "time_str")
    if not priced:
        return receipts
    return receipts.withColumns(
        {
            "discount_ratio": X.fill_missing(X.ratio(F.col("discounted_item_count"), size)),
            "avg_basket_unit_price": X.fill_missing(F.col("avg_basket_unit_price")),
            "avg_price_delta_per_basket": F.coalesce(F.col("avg_price_delta_per_basket"), F.lit(0.0)),
        }
    )


def _price_parts() -> list[Column]:
    return [
        F.sum(F.col("is_discounted").cast("int")).alias("discounted"),
        F.sum("avg_unit_price").alias("unit_price"),
        F.count("avg_unit_price").alias("unit_price_lines"),
        F.sum("price_delta").alias("delta"),
        F.count("price_delta").alias("delta_lines"),
    ]


def _price_totals() -> list[Column]:
    return [
        _total(F.col("discounted")).alias("discounted_item_count"),
        X.ratio(F.sum("unit_price"), F.sum("unit_price_lines")).alias("avg_basket_unit_price"),
        X.ratio(F.sum("delta"), F.sum("delta_lines")).alias("avg_price_delta_per_basket"),
    ]


def ensure_cashier(baskets: DataFrame) -> DataFrame:
    """Adds the cashier "N/A" where the relation has no cashier column."""
    if "cashier_id" in baskets.columns:
        return baskets
    return baskets.withColumn("cashier_id", F.lit("N/A"))


def validate_metrics(baskets: DataFrame) -> DataFrame:
    """Total and mean of the finite values of each checked metric, per period.

    ``status`` is OK, ZERO_ALERT or MISSING_COLUMN; ``impact`` says what an
    all-zero metric would break. One pass over the baskets.
    """
    sums = []
    for metric in schema.CHECKED_METRICS:
        if metric in baskets.columns:
            value = X.finite_or(F.col(metric), None)
            sums += [
                F.coalesce(F.sum(value), F.lit(0.0)).alias(f"{metric}__total"),
                F.coalesce(F.avg(value), F.lit(0.0)).alias(f"{metric}__avg"),
            ]
    rows = []
    for metric, business_name in schema.CHECKED_METRICS.items():
        present = metric in baskets.columns
        nothing = F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(metric).alias("metric"),
                F.lit(business_name).alias("business_name"),
                (F.col(f"{metric}__total") if present else nothing).alias("total"),
                (F.col(f"{metric}__avg") if present else nothing).alias("avg"),
                F.lit(_impact(metric)).alias("impact_area"),
            )
        )
    stats = baskets.groupBy("period").agg(*(sums or [F.count(F.lit(1)).alias("_rows")]))
    checked = stats.select("period", F.inline(F.array(*rows)))
    return checked.select(
        "period",
        "metric",
        "business_name",
        "total",
        "avg",
        F.when(F.col("total").isNull(), "MISSING_COLUMN")
        .when(F.col("total") == 0, "ZERO_ALERT")
        .otherwise("OK")
        .alias("status"),
        F.when(F.col("total") == 0, F.col("impact_area")).alias("impact"),
    )


def _impact(metric: str) -> str:
    if metric in schema.MISSION_METRICS:
        return "mission clustering"
    return "cashier risk" if metric in schema.RISK_METRICS else "general"
