"""Shopping missions: the bulk rule, KMeans segments, names and KPIs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tillscope import schema
from tillscope.functions import exprs as X
from tillscope.functions.lookup import attach_per_period
from tillscope.operators.clusters import kmeans_by_period

# Limits of the bulk purchase rule.
BULK_SIZE = 30
BULK_MIXED_SIZE = 10
BULK_MIXED_ITEM_VALUE = 150
# Fixed value: number of missions, the bulk mission included.
MISSION_COUNT = 6
# Limits that give a segment centre its mission name.
CENTER_BULK_SIZE = 15
CENTER_STOCK_UP_SIZE = 5
CENTER_FRESH_RATIO = 0.3
CENTER_SMALL_SIZE = 2.5
CENTER_PREMIUM_ITEM_VALUE = 45
CENTER_QUICK_ITEM_VALUE = 12


def bulk_rule() -> Column:
    size, item_value = F.col("basket_size"), F.col("basket_value_per_item")
    return (size > BULK_SIZE) | ((size > BULK_MIXED_SIZE) & (item_value > BULK_MIXED_ITEM_VALUE))


def flag_bulk(baskets: DataFrame) -> DataFrame:
    """Adds ``shopping_mission``: the bulk mission by rule, else PENDING."""
    return baskets.withColumn("shopping_mission", F.when(bulk_rule(), schema.B2B).otherwise("PENDING"))


def center_name(size: Column, item_value: Column, fresh: Column) -> Column:
    """Mission name of a segment centre; the first limit that applies decides."""
    small = size <= CENTER_SMALL_SIZE
    return (
        F.when(size > CENTER_BULK_SIZE, schema.B2B)
        .when(size > CENTER_STOCK_UP_SIZE, schema.STOCK_UP)
        .when(fresh > CENTER_FRESH_RATIO, schema.FRESH_PICK)
        .when(small & (item_value > CENTER_PREMIUM_ITEM_VALUE), schema.PREMIUM)
        .when(small & (item_value < CENTER_QUICK_ITEM_VALUE), schema.QUICK)
        .otherwise(schema.STANDARD)
    )


@dataclass(frozen=True)
class MissionModel:
    """Standardisation and segment centres (in standardised units)."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    centers: tuple[tuple[float, ...], ...]

    @classmethod
    def from_row(cls, row: Row) -> MissionModel:
        """The model in a row of a table of models."""
        centers = tuple(tuple(c) for c in row["centers"])
        return cls(tuple(row["features"]), tuple(row["mean"]), tuple(row["scale"]), centers)

    def to_row(self, period: str | None) -> tuple:
        return (period, list(self.features), list(self.mean), list(self.scale), [list(c) for c in self.centers])

    def standardized(self) -> list[Column]:
        return [
            (X.model_input(F.col(f)) - F.lit(m)) / F.lit(s)
            for f, m, s in zip(self.features, self.mean, self.scale, strict=True)
        ]

    def cluster(self) -> Column:
        """Number of the nearest centre; the lower number wins a tie."""
        point = self.standardized()
        candidates = []
        for index, center in enumerate(self.centers):
            squares = [(p - F.lit(c)) * (p - F.lit(c)) for p, c in zip(point, center, strict=True)]
            candidates.append(
                F.struct(reduce(lambda a, b: a + b, squares).alias("d"), F.lit(index).alias("i"))
            )
        return F.array_min(F.array(*candidates))["i"]

    def mission(self, centroid_space: str = "scaled") -> Column:
        """Mission name of the nearest centre.

        The name limits are compared with the standardised centres; with
        ``centroid_space="raw"`` with the centres in the features' own units.
        """
        raw = centroid_space == "raw"
        names = []
        for center in self.centers:
            shown = {
                f: F.lit(c * s + m if raw else c)
                for f, c, m, s in zip(self.features, center, self.mean, self.scale, strict=True)
            }
            names.append(center_name(*[shown[f] for f in schema.MISSION_FEATURES]))
        return F.array(*names)[self.cluster()]


def feature_moments(baskets: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per period: rows, and mean and population deviation of each model input."""
    aggs = []
    for f in features:
        value = X.model_input(F.col(f))
        aggs += [F.avg(value).alias(f"{f}__mean"), F.stddev_pop(value).alias(f"{f}__std")]
    return baskets.groupBy("period").agg(F.count(F.lit(1)).alias("rows"), *aggs)


def standardize(baskets: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``<feature>_scaled`` per period; a constant feature is only centred."""
    joined = attach_per_period(baskets, feature_moments(baskets, features).drop("rows"))
    scaled = {
        f"{f}_scaled": (X.model_input(F.col(f)) - F.col(f"{f}__mean"))
        / F.when(F.col(f"{f}__std") == 0, 1.0).otherwise(F.col(f"{f}__std"))
        for f in features
    }
    helpers = [f"{f}__{part}" for f in features for part in ("mean", "std")]
    return joined.withColumns(scaled).drop(*helpers)


#: A fitted model of each period; ``names`` are the missions of the centres, which are in standardised units.
MODEL_TABLE = (
    "period string, features array<string>, mean array<double>, scale array<double>, centers array<array<double>>"
)


_MODEL_COLUMNS = [c.split()[0] for c in MODEL_TABLE.split(", ")]


def _numbered(baskets: DataFrame, features: Sequence[str]) -> tuple[list, DataFrame, list[Column]]:
    """Moments of each period, the receipts with the number of theirs (``_period``), and the standardised features."""
    moments = feature_moments(baskets, features).orderBy("period").collect()
    mean = [[r[f"{f}__mean"] for f in features] for r in moments]
    scale = [[r[f"{f}__std"] or 1.0 for f in features] for r in moments]
    table = [(r["period"], i, m, s, r["rows"]) for i, (r, m, s) in enumerate(zip(moments, mean, scale, strict=True))]
    kind = "period string, _period int, _mean array<double>, _scale array<double>, _rows long"
    rows = attach_per_period(baskets, baskets.sparkSession.createDataFrame(table, kind))
    scaled = [(X.model_input(F.col(f)) - F.col("_mean")[i]) / F.col("_scale")[i] for i, f in enumerate(features)]
    return table, rows, scaled


def fit_period_models(
    pending: DataFrame,
    features: Sequence[str] = schema.MISSION_FEATURES,
    n_clusters: int = MISSION_COUNT,
    n_init: int = 10,
    seed: int = 42,
) -> DataFrame:
    """KMeans on the standardised receipts of each period, as a small table (``MODEL_TABLE``).

    The fits of all periods share their passes over ``pending``. A period without rows has no model. One with fewer
    distinct receipts than centres has as many centres as it has distinct receipts.
    """
    table, rows, scaled = _numbered(pending, features)
    ks = {i: [max(2, min(n_clusters - 1, n))] for _, i, _, _, n in table}
    fits = kmeans_by_period(rows, scaled, "receipt_id", ks, n_init, seed, "_period")
    models = [
        (period, list(features), mean, scale, fits[i][ks[i][0]][1].tolist()) for period, i, mean, scale, _ in table
    ]
    return pending.sparkSession.createDataFrame(models, MODEL_TABLE)


def fit_missions(
    pending: DataFrame,
    features: Sequence[str] = schema.MISSION_FEATURES,
    n_clusters: int = MISSION_COUNT,
    n_init: int = 10,
    seed: int = 42,
) -> MissionModel | None:
    """One model for all receipts, whatever their period; ``None`` without rows."""
    together = pending.withColumn("period", F.lit(None).cast("string"))
    model = fit_period_models(together, features, n_clusters, n_init, seed).first()
    return None if model is None else MissionModel.from_row(model)


def save_models(models: DataFrame, path: str) -> None:
    """Writes a table of models, for a later run."""
    models.select(*_MODEL_COLUMNS).coalesce(1).write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_TABLE).parquet(path)


def periods_of(df: DataFrame) -> list[str | None]:
    """The distinct periods; few by construction, as they come from the calendar."""
    return [r["period"] for r in df.select("period").distinct().orderBy("period").collect()]


def models_for(baskets: DataFrame, models: DataFrame) -> DataFrame:
    """The model to use for each period of ``baskets``: its own, else that of the last period before it, else the first.

    Both sides have one row per period, few by construction. A null period comes before all others.
    """
    place = lambda period: (period is not None, period or "")
    known = sorted((tuple(r) for r in models.select(*_MODEL_COLUMNS).collect()), key=lambda r: place(r[0]))
    chosen = []
    for period in periods_of(baskets) if known else []:
        before = [r for r in known if place(r[0]) <= place(period)]
        chosen.append((period, *(before[-1] if before else known[0])[1:]))
    return baskets.sparkSession.createDataFrame(chosen, MODEL_TABLE)


def _from_table(flagged: DataFrame, models: DataFrame, centroid_space: str) -> DataFrame:
    """Adds ``_segment``, the mission of the nearest centre of the period's model; null without a model."""
    widest = models.agg(F.max(F.size("centers")).alias("k"), F.max(F.size("features")).alias("p")).first()
    if not widest["k"]:
        return flagged.withColumn("_segment", F.lit(None).cast("string"))
    names = models.select("features").first()["features"]
    center = F.col("centers")
    # named where the models are, one row per period
    named = []
    for j in range(widest["k"]):
        value = {}
        for i, f in enumerate(names):
            v = F.get(F.get(center, F.lit(j)), F.lit(i))
            value[f] = v * F.get("scale", F.lit(i)) + F.get("mean", F.lit(i)) if centroid_space == "raw" else v
        named.append(center_name(*[value[f] for f in schema.MISSION_FEATURES]))
    table = models.select("period", F.struct("mean", "scale", "centers", F.array(*named).alias("names")).alias("_model"))
    joined = attach_per_period(flagged, table, "left")
    # element by element, so that the distances stay in generated code
    point = [
        (X.model_input(F.col(f)) - F.get("_model.mean", F.lit(i))) / F.get("_model.scale", F.lit(i))
        for i, f in enumerate(names)
    ]
    nearest = []
    for j in range(widest["k"]):
        parts = [p - F.get(F.get("_model.centers", F.lit(j)), F.lit(i)) for i, p in enumerate(point)]
        squared = reduce(lambda a, b: a + b, [d * d for d in parts])
        nearest.append(F.when(squared.isNotNull(), F.struct(squared.alias("d"), F.lit(j).alias("i"))))
    label = F.array_min(F.array(*nearest))["i"]
    return joined.withColumn("_segment", F.get("_model.names", label)).drop("_model")


def assign_missions(
    baskets: DataFrame, models: MissionModel | DataFrame, centroid_space: str = "scaled"
) -> DataFrame:
    """Names the receipts: bulk rule first, then the nearest centre of the one model, or of the period's in a table."""
    flagged = flag_bulk(baskets)
    if isinstance(models, MissionModel):
        flagged = flagged.withColumn("_segment", models.mission(centroid_space))
    else:
        flagged = _from_table(flagged, models, centroid_space)
    segment = F.coalesce("_segment", F.lit(schema.STANDARD))
    mission = F.col("shopping_mission")
    return flagged.withColumn("shopping_mission", F.when(mission == "PENDING", segment).otherwise(mission)).drop("_segment")


def segment_missions(
    baskets: DataFrame,
    features: Sequence[str] = schema.MISSION_FEATURES,
    n_clusters: int = MISSION_COUNT,
    model: MissionModel | DataFrame | None = None,
    centroid_space: str = "scaled",
    n_init: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Adds ``shopping_mission``; fits one model per period unless given one, or a table of them.

    Of a given table each period takes the model that ``models_for`` says. ``baskets`` is
    read for every fit and once more, so callers pass a staged table.
    """
    if model is None:
        model = fit_period_models(baskets.where(~F.coalesce(bulk_rule(), F.lit(False))), features, n_clusters, n_init, seed)
    elif isinstance(model, DataFrame):
        model = models_for(baskets, model)
    return assign_missions(baskets, model, centroid_space)


def elbow_curve(
    baskets: DataFrame,
    features: Sequence[str] = schema.MISSION_FEATURES,
    max_k: int = 10,
    n_init: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Per period the within-cluster squared distances for k = 2..max_k, and the k in use.

    k stays below the number of receipts; a period of fewer than three has no curve. All fits share their passes.
    """
    table, rows, scaled = _numbered(baskets, features)
    ks = {i: range(2, min(max_k, n - 1) + 1) for _, i, _, _, n in table}
    best = kmeans_by_period(rows, scaled, "receipt_id", ks, n_init, seed, "_period")
    curve = [
        (period, k, float(best[i][k][0]), MISSION_COUNT) for period, i, _, _, _ in table for k in sorted(best.get(i, ()))
    ]
    return baskets.sparkSession.createDataFrame(curve, "period string, k int, wcss double, recommended_k int")


def mission_insights(baskets: DataFrame) -> DataFrame:
    """KPIs of each mission with its share of the period's revenue and receipts."""
    missions = baskets.groupBy("period", "shopping_mission").agg(
        F.count(F.lit(1)).alias("receipt_count"),
        F.sum("basket_value").alias("total_mission_revenue"),
        F.round(F.avg("basket_value"), 2).alias("avg_trip_value"),
        F.round(F.avg("basket_size"), 2).alias("avg_items_per_trip"),
    )
    period = Window.partitionBy("period")  # at most six missions each
    return missions.withColumns(
        {
            "revenue_share_pct": F.round(
                X.ratio(F.col("total_mission_revenue"), F.sum("total_mission_revenue").over(period))
                * 100,
                3,
            ),
            "traffic_share_pct": F.round(
                X.ratio(F.col("receipt_count"), F.sum("receipt_count").over(period)) * 100, 3
            ),
        }
    ).orderBy("period", F.desc("revenue_share_pct"), "shopping_mission")


def bulk_audit(baskets: DataFrame) -> DataFrame:
    """Bulk receipts with the z-score of their value among all receipts of the period."""
    stats = baskets.groupBy("period").agg(
        F.avg("basket_value").alias("_mean"), F.stddev_samp("basket_value").alias("_std")
    )
    bulk = baskets.where(F.col("shopping_mission") == schema.B2B)
    return (
        attach_per_period(bulk, stats)
        .withColumn("anomaly_score", X.ratio(F.col("basket_value") - F.col("_mean"), F.col("_std")))
        .drop("_mean", "_std")
    )
