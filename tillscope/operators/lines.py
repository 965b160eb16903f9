"""Receipt lines: normalisation, calendar columns, price features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope import schema
from tillscope.functions import exprs as X
from tillscope.functions.lookup import attach
from tillscope.functions.quantiles import group_quantiles, median


def normalize_lines(raw: DataFrame) -> DataFrame:
    """Raw point-of-sale columns to canonical names, text ids and parsed flags.

    ``hour_of_day`` is null where the time is not ``HH:MM``. Other columns of
    the input, such as ``period``, are kept.
    """
    wanted = [*schema.RAW_TO_CANONICAL, *schema.RAW_FLAGS]
    missing = [c for c in wanted if c not in raw.columns]
    if missing:
        raise ValueError(f"receipt lines lack the columns {missing}")
    return (
        raw.withColumnsRenamed(schema.RAW_TO_CANONICAL)
        .withColumns(
            {
                "receipt_id": F.col("receipt_id").cast("string"),
                "product_id": F.col("product_id").cast("string"),
                "hour_of_day": X.clock_hour(F.col("time_str")),
                **{flag: X.text_flag(F.col(raw_flag)) for raw_flag, flag in schema.RAW_FLAGS.items()},
            }
        )
        .drop(*schema.RAW_FLAGS)
    )


def time_quality(lines: DataFrame) -> DataFrame:
    """Per period, the lines whose date or time could not be read."""
    hour = X.hour_prefix(F.col("time_str"))
    day = X.parse_day(F.col("date_str"))
    return lines.groupBy("period").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(F.col("time_str").isNotNull() & hour.isNull()).alias("bad_time_count"),
        F.count_if(F.col("date_str").isNotNull() & day.isNull()).alias("bad_date_count"),
        F.count_if(F.col("time_str").isNull()).alias("missing_time_count"),
        F.count_if(F.col("date_str").isNull()).alias("missing_date_count"),
    )


def line_calendar(lines: DataFrame) -> DataFrame:
    """Adds date, hour, weekday, weekend, peak, store and freshness columns."""
    scan = F.col("selfScanning")
    return (
        lines.withColumns(
            {
                "date_str": X.parse_day(F.col("date_str")),
                "hour_of_day": X.hour_prefix(F.col("time_str")),
                "selfScanning": F.when(scan == "Y", 1).when(scan == "N", 0).cast("byte"),
                "store_numeric": X.md5_bucket(F.col("store_id"), 1000),
                "weight": X.finite_or(F.col("weight"), 0.0),
            }
        )
        .withColumns(
            {
                "day_of_week": X.iso_weekday(F.col("date_str")),
                "is_weekend": X.weekend_flag(F.col("date_str")),
                "peak_hour_pressure_numeric": X.peak_flag(F.col("hour_of_day")),
                "is_fresh": F.col("weight") > 0,
            }
        )
    )


def standard_price(lines: DataFrame) -> DataFrame:
    """Median line total of each product in each period."""
    medians = group_quantiles(
        lines, ["period", "product_id"], "line_total", {"Standard_Price": median()}
    )
    return medians.withColumnRenamed("n", "priced_lines")


def line_price_features(lines: DataFrame) -> DataFrame:
    """Adds the standard price of the product and the price features of the line."""
    prices = standard_price(lines).drop("priced_lines")
    total, weight = F.col("line_total"), X.as_double(F.col("weight"))
    return attach(lines, prices, ["period", "product_id"]).withColumns(
        {
            "is_discounted": F.coalesce(total < F.col("Standard_Price"), F.lit(False)),
            "price_delta": F.coalesce(X.as_double(total - F.col("Standard_Price")), F.lit(0.0)),
            "avg_unit_price": F.coalesce(
                F.when(weight > 0, X.as_double(total) / weight).otherwise(X.as_double(total)),
                F.lit(0.0),
            ),
        }
    )


def lines_per_receipt(lines: DataFrame) -> DataFrame:
    """Receipts, lines and mean lines per receipt of each period."""
    receipts = lines.groupBy("period", "receipt_id").agg(F.count(F.lit(1)).alias("lines"))
    return receipts.groupBy("period").agg(
        F.count(F.lit(1)).alias("receipt_count"),
        F.sum("lines").alias("line_count"),
        X.ratio(F.sum("lines"), F.count(F.lit(1))).alias("avg_lines_per_receipt"),
    )
