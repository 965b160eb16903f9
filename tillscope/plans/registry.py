"""The registered queries: each takes a session and a folder of tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope import schema
from tillscope.functions import exprs as X
from tillscope.operators import audits, baskets, lines, missions, outliers, selection
from tillscope.operators.missions import MissionModel
from tillscope.plans import reports
from tillscope.session import scratch_dir, stage
from tillscope.sources import receipts
from tillscope.sources.driver_tables import order_year, raw_receipt_lines
from tillscope.sources.receipts import hash_sample

Query = Callable[[SparkSession, str], DataFrame]

# A given model, so that SQL can follow the assignment.
GIVEN_MODEL = MissionModel(
    features=schema.MISSION_FEATURES,
    mean=(4.0, 52000.0, 0.65),
    scale=(2.0, 20000.0, 0.5),
    centers=(
        (-1.0, -0.8, -1.3),
        (-1.0, 0.9, -1.3),
        (-0.6, 0.2, 0.7),
        (0.5, 0.0, 0.7),
        (6.0, -0.1, 0.2),
    ),
)


def _lines(spark: SparkSession, sf_dir: str, by_year: bool = False, period: Column | None = None) -> DataFrame:
    period = order_year() if by_year else period
    return lines.normalize_lines(raw_receipt_lines(spark, sf_dir, period))


_PRICE_COLUMNS = ("period", "receipt_id", "product_id", "line_total", "weight")
_BASKET_COLUMNS = (
    *_PRICE_COLUMNS, "date_str", "time_str", "cashier_id", "store_id", "is_item_void",
)


def _written(lines_: DataFrame, *columns: str) -> DataFrame:
    """The needed columns, written once: price features read the lines twice."""
    return stage(lines_.select(*columns), "lines")


def _baskets(spark: SparkSession, sf_dir: str, by_year: bool = False) -> DataFrame:
    narrow = _written(_lines(spark, sf_dir, by_year), *_BASKET_COLUMNS)
    return baskets.basket_features(lines.line_price_features(narrow))


def _core(spark: SparkSession, sf_dir: str, by_year: bool = False, period: Column | None = None) -> DataFrame:
    """Receipts without price features: no product median, nothing written, columns pruned."""
    return baskets.basket_features(_lines(spark, sf_dir, by_year, period))


# What the models and audits of receipts read.
_MODEL_COLUMNS = ("period", "receipt_id", "basket_value", *schema.MISSION_FEATURES)


def _staged(spark: SparkSession, sf_dir: str, by_year: bool = False, period: Column | None = None) -> DataFrame:
    """The receipts' columns for models, written once: they are read several times."""
    return stage(_core(spark, sf_dir, by_year, period).select(*_MODEL_COLUMNS), "receipts")


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _settled(df: DataFrame, count: str, units: Mapping[str, int]) -> DataFrame:
    """Means rounded to four digits, half up, in whole numbers.

    Means of prices often end exactly half-way, where the last bit of a sum of
    doubles, and so the order of adding, would decide. A unit says of how many parts of
    one the summed values are whole numbers; the sum in these parts is one too.
    """
    n = F.col(count).cast("long")

    def rounded(column: str, unit: int) -> Column:
        total = F.round(F.col(column) * n * F.lit(float(unit))).cast("long")
        up = F.floor((F.abs(total) * 20_000 + n * unit).cast("decimal(38,0)") / (n * (2 * unit)).cast("decimal(20,0)"))
        return F.signum(total.cast("double")) * up / F.lit(1e4)

    return df.withColumns({c: rounded(c, unit) for c, unit in units.items()})


def scan_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the first half of the months March to May 1997."""
    day = F.col("o_orderdate")
    # the range reaches the files; the days are left to a filter
    wanted = (day >= F.lit("1997-03-01").cast("date")) & (day < F.lit("1997-06-01").cast("date"))
    raw = raw_receipt_lines(spark, sf_dir, wanted=wanted & F.dayofmonth(day).between(1, 15))
    return lines.normalize_lines(raw).select(
        "receipt_id", "product_id", "line_total", "weight", "store_id", "date_str", "cashier_id"
    ).withColumn("line_total", X.as_double(F.col("line_total")))


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def scan_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first halves of the months March to May 1997, from folders: all lines are written by half month, below two areas.

    The second area has branches of its own above the years, so its folders lie deeper.
    """
    root = _scratch(spark, "layout")
    raw = raw_receipt_lines(spark, sf_dir, F.date_format("o_orderdate", "yyyyMMdd"))
    date = F.to_date("period", "yyyyMMdd")
    half = F.when(F.dayofmonth(date) <= 15, 1).otherwise(16)
    keyed = raw.withColumns({"year": F.year(date), "month": F.month(date), "day": half}).drop("period")
    keyed = keyed.hint("rebalance", "year", "month", "day")
    first = F.substring("negozioCodice", 2, 1).cast("int") < 5
    for wanted, branch in ((first, "area=382"), (~first, "area=500/north/inner")):
        to = f"{root}/{receipts.LINES_FOLDER}/{branch}"
        keyed.where(wanted).write.partitionBy("year", "month", "day").parquet(to)
    raw = receipts.scan_period(spark, root, 1997, 3, month_end=5, day=1, day_end=15)
    return lines.normalize_lines(raw).select(
        "area", "period", "receipt_id", "product_id", X.as_double(F.col("line_total")).alias("line_total"), "store_id"
    )


_CSV_COLUMNS = T.StructType(
    [
        T.StructField(name, T.DoubleType() if name == "line_total" else T.StringType())
        for name in ("receipt_id", "product_id", "cashier_id", "line_total", "date_str")
    ]
)


def _csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines from folders of their stores: parquet for some, semicolon text with ragged and bad rows for the others."""
    root = _scratch(spark, "stores")
    names = [c.name for c in _CSV_COLUMNS]
    rows = _lines(spark, sf_dir).select("store_id", *names, F.col("product_id").cast("int").alias("n"))
    rows = rows.withColumn("line_total", X.as_double(F.col("line_total")))
    plain = F.col("store_id") < "S3"
    folder = lambda kind: f"{root}/{kind}"
    clean = rows.where(plain).drop("n").hint("rebalance", "store_id")
    clean.write.partitionBy("store_id").parquet(folder("clean"))
    fields = [F.col(c).cast("string") for c in names]
    fields[3] = F.when(F.col("n") % 23 == 0, "n/a").otherwise(fields[3])
    text = (
        F.when(F.col("n") % 17 == 0, F.concat_ws(";", *fields[:3]))
        .when(F.col("n") % 19 == 0, F.concat_ws(";", *fields, F.lit("late"), F.lit("later")))
        .otherwise(F.concat_ws(";", *fields))
    )
    ragged = rows.where(~plain)
    body = ragged.select("store_id", F.lit(1).alias("place"), text.alias("value"))
    head = ragged.select("store_id").distinct().select("store_id", F.lit(0).alias("place"), F.lit(";".join(names)).alias("value"))
    # one file for each store, its header first
    ordered = body.union(head).repartition("store_id").sortWithinPartitions("store_id", "place")
    ordered.select("store_id", "value").write.partitionBy("store_id").text(folder("ragged"))
    return receipts.read_folders(spark, [folder("clean"), folder("ragged")], _CSV_COLUMNS)


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_rows(spark, sf_dir).select(*[c.name for c in _CSV_COLUMNS], "problem", "format")


def csv_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short, long and unparseable rows of each store's files."""
    per_file = receipts.file_quality(_csv_rows(spark, sf_dir))
    store = F.regexp_extract("file", "store_id=([^/]+)/", 1).alias("store_id")
    sums = [F.sum(c).alias(c) for c in per_file.columns if c.endswith("_count")]
    return per_file.groupBy(store, "format").agg(*sums)


def preview_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look at the lines: five of them, by receipt and price."""
    rows = _lines(spark, sf_dir).select("receipt_id", "product_id", X.as_double(F.col("line_total")).alias("line_total"))
    return receipts.preview(rows.orderBy("receipt_id", "line_total", "product_id"))


def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _lines(spark, sf_dir)
    money = {c: X.as_double(F.col(c)) for c in ("line_total", "total_discounts")}
    return out.withColumns(money).drop("period")


def hash_sample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = hash_sample(_lines(spark, sf_dir), "receipt_id", 0.1)
    return sample.select("receipt_id", "product_id", X.as_double(F.col("line_total")).alias("line_total"))


def line_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_calendar(_lines(spark, sf_dir)).select(
        "receipt_id", "product_id", "date_str", "hour_of_day", "day_of_week", "is_weekend",
        "selfScanning", "store_numeric", "weight", "peak_hour_pressure_numeric", "is_fresh",
    )


def time_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.time_quality(_lines(spark, sf_dir))


def _dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with missing and malformed values, by remainders of the product number."""
    product = F.col("product_id").cast("int")

    def spoilt(column: str, absent: int, bad: int | None = None, value: object = None) -> Column:
        out = F.when(product % absent != 0, F.col(column))
        return out if bad is None else F.when(product % bad == 0, F.lit(value)).otherwise(out)

    return _lines(spark, sf_dir).withColumns(
        {
            "weight": spoilt("weight", 20, 12, float("nan")),
            "cashier_id": spoilt("cashier_id", 5),
            "payment_method_code": spoilt("payment_method_code", 6),
            "date_str": spoilt("date_str", 11, 7, "bad"),
            "time_str": spoilt("time_str", 13, 9, "xx:yy"),
        }
    )


def dirty_time_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.time_quality(_dirty_lines(spark, sf_dir))


def dirty_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets.basket_features(_dirty_lines(spark, sf_dir)).select(
        "receipt_id", "basket_size", "has_fresh_produce", "fresh_weight_sum", "total_weight",
        "fresh_value_sum", "cashier_id", "store_id", "hour_of_day", "is_weekend",
    )


def dirty_cashier_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.cashier_receipts(_dirty_lines(spark, sf_dir))


def dirty_produce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.produce_weighing_errors(_dirty_lines(spark, sf_dir))


def standard_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.standard_price(_lines(spark, sf_dir))
    return out.withColumn("Standard_Price", X.as_double(F.col("Standard_Price")))


def line_price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = _written(_lines(spark, sf_dir), *_PRICE_COLUMNS)
    return lines.line_price_features(narrow).select(
        "receipt_id",
        "product_id",
        X.as_double(F.col("line_total")).alias("line_total"),
        X.as_double(F.col("Standard_Price")).alias("Standard_Price"),
        "is_discounted",
        "price_delta",
        "avg_unit_price",
        F.col("period").alias("partition_key"),
    )


def lines_per_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines_per_receipt(_lines(spark, sf_dir))


# Prices by weight are no whole cents; a millionth is as near as doubles allow.
_BASKET_MEANS = {"avg_basket_unit_price": 1_000_000, "avg_price_delta_per_basket": 200}


def canonical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(_baskets(spark, sf_dir), "basket_size", _BASKET_MEANS)


def canonical_features_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(_baskets(spark, sf_dir, by_year=True), "basket_size", _BASKET_MEANS)


def validate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(baskets.validate_metrics(_core(spark, sf_dir)), 4, "total", "avg")


def validate_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of receipts that lack a metric and have another at zero."""
    partial = _core(spark, sf_dir, by_year=True).drop("leakage_pct").withColumn("total_voids", F.lit(0))
    return _rounded(baskets.validate_metrics(partial), 4, "total", "avg")


def receipts_without_cashier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount scores where the till names no cashier: all receipts are of one, who has no peers."""
    receipts_ = baskets.ensure_cashier(_core(spark, sf_dir).withColumn("discount_ratio", F.lit(0.5)).drop("cashier_id"))
    return audits.tag_cashier_sweethearting(stage(receipts_, "discounts")).select(
        "receipt_id", "cashier_id", "cashier_sweethearting_z_score", "cashier_sweethearting_anomaly_score"
    )


def mission_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missions.flag_bulk(_core(spark, sf_dir)).select(
        "receipt_id", "basket_size", "basket_value_per_item", "shopping_mission"
    )


def mission_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = missions.assign_missions(_core(spark, sf_dir), GIVEN_MODEL, "raw")
    return named.withColumn("cluster", GIVEN_MODEL.cluster()).select(
        "receipt_id", "cluster", "shopping_mission"
    )


def mission_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given model, written as a table and read by a later run whose periods it doesn't know."""
    path = _scratch(spark, "models")
    missions.save_models(spark.createDataFrame([GIVEN_MODEL.to_row("1991")], missions.MODEL_TABLE), path)
    models = missions.load_models(spark, path)
    named = missions.segment_missions(_staged(spark, sf_dir, by_year=True), model=models, centroid_space="raw")
    return named.select("period", "receipt_id", "shopping_mission")


def _insights(spark: SparkSession, sf_dir: str, by_year: bool) -> DataFrame:
    named = missions.assign_missions(_core(spark, sf_dir, by_year), GIVEN_MODEL, "raw")
    return _rounded(missions.mission_insights(named), 2, "total_mission_revenue")


def mission_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insights(spark, sf_dir, by_year=False)


def mission_insights_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insights(spark, sf_dir, by_year=True)


def report_missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mission_report(_insights(spark, sf_dir, by_year=True))


def standardized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = [f"{f}_scaled" for f in schema.MISSION_FEATURES]
    out = missions.standardize(_staged(spark, sf_dir), schema.MISSION_FEATURES)
    return _rounded(out.select("receipt_id", *scaled), 6, *scaled)


def centroid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names the mean receipt of each store and basket size."""
    centers = _core(spark, sf_dir).groupBy("store_id", "basket_size").agg(
        F.count(F.lit(1)).alias("receipts"),
        F.round(F.avg("basket_value_per_item"), 4).alias("item_value"),
        F.round(F.avg("freshness_weight_ratio"), 6).alias("fresh_ratio"),
    )
    name = missions.center_name(F.col("basket_size"), F.col("item_value"), F.col("fresh_ratio"))
    return centers.withColumn("mission", name)


def mission_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missions.segment_missions(_staged(spark, sf_dir)).select("receipt_id", "shopping_mission")


def elbow_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missions.elbow_curve(_staged(spark, sf_dir))


def b2b_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = missions.flag_bulk(_staged(spark, sf_dir))
    out = missions.bulk_audit(named).select(
        "period", "receipt_id", "basket_value", "basket_size", "shopping_mission", "anomaly_score"
    )
    return _rounded(out, 6, "anomaly_score")


def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of the value per item below the usual."""
    scored = _staged(spark, sf_dir).select(
        "period", "receipt_id", F.col("basket_value_per_item").alias("anomaly_score")
    )
    return audits.severity(scored)


def _spoilt_period() -> Column:
    """The year, unknown for orders of February."""
    return F.when(F.month("o_orderdate") != 2, order_year())


def dirty_period_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity where a part of the receipts has no period."""
    scored = _staged(spark, sf_dir, period=_spoilt_period()).select(
        "period", "receipt_id", F.col("basket_value_per_item").alias("anomaly_score")
    )
    return audits.severity(scored)


def dirty_period_missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missions of receipts of which a part has no period, by a table of models."""
    models = spark.createDataFrame([GIVEN_MODEL.to_row(None), GIVEN_MODEL.to_row("1995")], missions.MODEL_TABLE)
    receipts_ = _staged(spark, sf_dir, period=_spoilt_period())
    named = missions.segment_missions(receipts_, model=models, centroid_space="raw")
    return named.groupBy("period", "shopping_mission").agg(F.count(F.lit(1)).alias("receipt_count"))


# Given trees, so that SQL can follow the paths: features by their place, cuts and depths in heap order.
GIVEN_FOREST = outliers.IsolationForests(
    features=schema.MISSION_FEATURES,
    tree_rows=(64, 64),
    feature=np.array([[0, 1, 2], [1, 0, 2], [2, 1, 0], [0, 0, 1]]),
    threshold=np.array([[4.0, 40_000.0, 0.5], [60_000.0, 2.0, 0.9], [0.2, 30_000.0, 6.0], [3.0, 1.0, 50_000.0]]),
    depths=np.array([[3.0, 5.5, 6.25, 2.0], [6.0, 4.5, 2.5, 3.75], [2.25, 5.0, 6.5, 3.0], [1.5, 4.0, 5.25, 2.75]]),
)


def forest_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path scores of the given forests, one for years before 1995 and one for the others, and their severity."""
    number = (F.col("period") >= "1995").cast("int")
    scored = _staged(spark, sf_dir, by_year=True).withColumn("anomaly_score", GIVEN_FOREST.score(number))
    scored = scored.withColumn("anomaly_score", F.round(F.col("anomaly_score") - F.lit(outliers.AUTO_OFFSET), 9))
    return audits.severity(scored.select("period", "receipt_id", "anomaly_score"))


def rf_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.rf_importance(_staged(spark, sf_dir))


def rf_importance_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.rf_importance(_staged(spark, sf_dir, by_year=True))


def _moments(receipts_: DataFrame) -> DataFrame:
    out = selection.lasso_moments(receipts_)
    sums = [c for c in out.columns if c not in ("period", "fold", "n")]
    # y sums are large; relative agreement is what counts
    scaled = {c: F.round(F.col(c) / (1e6 if "y" in c else 1.0), 3) for c in sums if c != "yy"}
    return out.withColumns({**scaled, "yy": F.round(F.col("yy") / 1e12, 3)})


def lasso_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(_staged(spark, sf_dir))


def lasso_moments_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(_staged(spark, sf_dir, by_year=True))


def lasso_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.lasso_importance(_staged(spark, sf_dir))


def lasso_importance_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.lasso_importance(_staged(spark, sf_dir, by_year=True))


def consensus_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus per year of two importances that SQL can follow: shares of squared correlation, and covariances."""
    rows = missions.standardize(_staged(spark, sf_dir, by_year=True), schema.MISSION_FEATURES)
    value = F.col("basket_value")
    found = []
    for f in schema.MISSION_FEATURES:
        x = F.col(f"{f}_scaled")
        found.append(F.struct(F.lit(f).alias("feature"), F.corr(x, value).alias("r"), F.covar_pop(x, value).alias("c")))
    table = stage(rows.groupBy("period").agg(F.array(*found).alias("f")).select("period", F.inline("f")), "relations")
    importance = table.where(F.abs("r") > 0.05).select("period", "feature", (F.col("r") * F.col("r")).alias("importance"))
    return selection.consensus_features(importance, table.select("period", "feature", F.col("c").alias("coefficient")))


def consensus_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = _staged(spark, sf_dir)
    return selection.consensus_features(
        selection.rf_importance(receipts), selection.lasso_importance(receipts)
    )


def vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selection.vif(_core(spark, sf_dir)), 6, "vif").drop("period")


def vif_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selection.vif(_core(spark, sf_dir, by_year=True)), 6, "vif")


def anomaly_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = _staged(spark, sf_dir)
    return outliers.anomaly_score(receipts, schema.MISSION_FEATURES).select(
        "receipt_id", "anomaly_score"
    )


def cashier_sweethearting(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = "cashier_sweethearting_z_score"
    receipts = stage(
        _baskets(spark, sf_dir).select("period", "receipt_id", "cashier_id", "basket_value", "discount_ratio"), "discounts"
    )
    out = audits.tag_cashier_sweethearting(receipts).select(
        "receipt_id", "cashier_id", z, "cashier_sweethearting_anomaly_score"
    )
    return _rounded(out, 6, z)


def _alerts(spark: SparkSession, sf_dir: str, by_year: bool = False) -> DataFrame:
    alerts = audits.cashier_alerts(_baskets(spark, sf_dir, by_year))
    return _rounded(alerts, 6, "cashier_sweethearting_z_score")


def cashier_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir)


def cashier_alerts_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir, by_year=True)


def report_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.integrity_report(_alerts(spark, sf_dir))


def _produce(spark: SparkSession, sf_dir: str, by_year: bool) -> DataFrame:
    # only weighed lines with a price count, a small part of all lines
    columns = ("period", "product_id", "receipt_id", "date_str", "store_id", "line_total", "weight")
    weighed = _lines(spark, sf_dir, by_year).where((F.col("weight") > 0) & (F.col("line_total") > 0))
    return audits.produce_weighing_errors(_written(weighed, *columns))


def produce_weighing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _produce(spark, sf_dir, by_year=False)


def produce_weighing_errors_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _produce(spark, sf_dir, by_year=True)


def cashier_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.cashier_receipts(_lines(spark, sf_dir))


_FINGERPRINT_MEANS = {
    "avg_transaction_value": 100, "void_rate_per_receipt": 1, "abort_rate": 1, "cash_reliance_ratio": 1,
}


def cashier_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audits.cashier_fingerprint(_lines(spark, sf_dir))
    return _settled(out, "total_transactions", _FINGERPRINT_MEANS)


def _risks(spark: SparkSession, sf_dir: str, by_year: bool = False) -> DataFrame:
    return audits.behavioral_risk(audits.cashier_fingerprint(_lines(spark, sf_dir, by_year)))


def _shown_risks(risks: DataFrame) -> DataFrame:
    return _rounded(_settled(risks, "total_transactions", _FINGERPRINT_MEANS), 6, "risk_score")


def behavioral_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_risks(_risks(spark, sf_dir))


def behavioral_risk_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_risks(_risks(spark, sf_dir, by_year=True))


def report_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.behavior_report(audits.risk_report(_risks(spark, sf_dir)))


def behavioral_risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.risk_report(_risks(spark, sf_dir))


def behavioral_outlier_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stage(audits.cashier_fingerprint(_lines(spark, sf_dir)), "fingerprints")
    return outliers.behavioral_outliers(prints).select("period", "cashier_id", "iso_outlier_score")


def margin_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.margin_leakage(_lines(spark, sf_dir))


def margin_leakage_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.margin_leakage(_lines(spark, sf_dir, by_year=True))


def report_behavioral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.behavior_report(audits.margin_leakage(_lines(spark, sf_dir)))


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents of all years, written as JSON and read back: records and sums of each section."""
    read = _lines(spark, sf_dir, by_year=True)
    sections = {
        "insight_mensili": reports.mission_report(_insights(spark, sf_dir, by_year=True)),
        "fingerprint_comportamentale_cassieri": reports.behavior_report(audits.risk_report(_risks(spark, sf_dir, by_year=True))),
        "analisi_perdita_margine": reports.behavior_report(audits.margin_leakage(read)),
    }
    documents = reports.period_documents("Missioni e cassieri", "Tutte le sezioni per anno.", sections)
    path = _scratch(spark, "documents")
    reports.write_documents(documents, path)
    back = reports.read_documents(spark, path, documents)
    summed = {
        "insight_mensili": "Fatturato Totale Missione",
        "fingerprint_comportamentale_cassieri": "Score Rischio Comportamentale",
        "analisi_perdita_margine": "Fatturato Acquisito",
    }

    def section(name: str, field: str) -> Column:
        total = F.aggregate(name, F.lit(0.0), lambda sum_, record: sum_ + record[field])
        return F.struct(F.lit(name).alias("section"), F.size(name).alias("records"), F.round(total, 2).alias("total"))

    rows = [section(*pair) for pair in summed.items()]
    return back.select(
        "periodo", F.size("metadata.dizionario_dati").alias("fields"), F.inline(F.array(*rows))
    )


QUERIES: dict[str, Query] = {
    "scan_period": scan_period,
    "scan_layout": scan_layout,
    "csv_lines": csv_lines,
    "csv_quality": csv_quality,
    "preview_lines": preview_lines,
    "hash_sample": hash_sample_query,
    "normalize_lines": normalize_lines,
    "line_calendar": line_calendar,
    "time_quality": time_quality,
    "dirty_time_quality": dirty_time_quality,
    "dirty_receipts": dirty_receipts,
    "dirty_cashier_receipts": dirty_cashier_receipts,
    "dirty_produce": dirty_produce,
    "standard_price": standard_price,
    "line_price_features": line_price_features,
    "lines_per_receipt": lines_per_receipt,
    "canonical_features": canonical_features,
    "canonical_features_by_period": canonical_features_by_period,
    "validate_metrics": validate_metrics,
    "validate_partial": validate_partial,
    "receipts_without_cashier": receipts_without_cashier,
    "mission_rule": mission_rule,
    "mission_assign": mission_assign,
    "mission_reuse": mission_reuse,
    "dirty_period_missions": dirty_period_missions,
    "mission_insights": mission_insights,
    "mission_insights_by_period": mission_insights_by_period,
    "report_missions": report_missions,
    "standardized_features": standardized_features,
    "centroid_names": centroid_names,
    "mission_segmentation": mission_segmentation,
    "elbow_curve": elbow_curve,
    "b2b_audit": b2b_audit,
    "severity": severity,
    "dirty_period_severity": dirty_period_severity,
    "forest_severity": forest_severity,
    "rf_importance": rf_importance,
    "rf_importance_by_period": rf_importance_by_period,
    "lasso_moments": lasso_moments,
    "lasso_moments_by_period": lasso_moments_by_period,
    "lasso_importance": lasso_importance,
    "lasso_importance_by_period": lasso_importance_by_period,
    "consensus_features": consensus_features,
    "consensus_correlations": consensus_correlations,
    "vif": vif,
    "vif_by_period": vif_by_period,
    "anomaly_score": anomaly_score,
    "cashier_sweethearting": cashier_sweethearting,
    "cashier_alerts": cashier_alerts,
    "cashier_alerts_by_period": cashier_alerts_by_period,
    "report_integrity": report_integrity,
    "produce_weighing_errors": produce_weighing_errors,
    "produce_weighing_errors_by_period": produce_weighing_errors_by_period,
    "cashier_receipts": cashier_receipts,
    "cashier_fingerprint": cashier_fingerprint,
    "behavioral_risk": behavioral_risk,
    "behavioral_risk_by_period": behavioral_risk_by_period,
    "behavioral_risk_report": behavioral_risk_report,
    "report_risk": report_risk,
    "behavioral_outlier_label": behavioral_outlier_label,
    "margin_leakage": margin_leakage,
    "margin_leakage_by_period": margin_leakage_by_period,
    "report_behavioral": report_behavioral,
    "report_documents": report_documents,
}
