"""Feature selection: forest and lasso importance, their consensus, and VIF; all for each period by itself."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope import schema
from tillscope.functions import exprs as X
from tillscope.functions.lookup import attach_per_period
from tillscope.functions.quantiles import Pick, group_quantiles
from tillscope.operators.forests import cell_importance
from tillscope.operators.missions import standardize
from tillscope.session import stage

# Size of the forest and of its report.
FOREST_TREES = 100
TOP_FEATURES = 3
FOREST_DEPTH, FOREST_BINS = 10, 128
FOREST_MEMORY_MB = 256
FOREST_PART_ROWS = 50_000
# Rows from which a period is fitted from its cells, and cells that a period may have for that.
FOREST_CELL_ROWS = 100_000
FOREST_CELLS = 1 << 21
# Folds, penalties and cut of the lasso path.
LASSO_FOLDS = 5
LASSO_ALPHAS = 100
LASSO_PATH_LENGTH = 1e-3
LASSO_MIN_ROWS = 5
LASSO_MIN_COEFFICIENT = 1e-3
# A VIF below this passes; rows that a sample keeps at least.
VIF_LIMIT = 5.0
VIF_SAMPLE_FLOOR = 100

TARGET = "basket_value"
_IMPORTANCE = "period string, feature string, importance double"
# Forests fitted at the same time.
CONCURRENT_FITS = 4


def rf_importance(
    baskets: DataFrame,
    features: Sequence[str] = schema.MISSION_FEATURES,
    target: str = TARGET,
    top_n: int = TOP_FEATURES,
    seed: int = 42,
    max_depth: int = FOREST_DEPTH,
    max_bins: int = FOREST_BINS,
) -> DataFrame:
    """The ``top_n`` impurity importances of a random forest for each period, highest first.

    The model columns are written once, in one folder per period. Large periods are fitted together from their
    cells (``forests.cell_importance``), whose number doesn't grow with the rows. Small ones, which have about as many
    cells as rows, and models of so many features that cells would be many, are fitted by MLlib: a few fits
    run at the same time, each reads only its period, so a small period's jobs fill the gaps of another's.
    """
    spark = baskets.sparkSession
    columns = [*features, target]
    # the id tells receipts of equal values apart where the rows of a bootstrap sample are drawn
    ids = [c for c in ("receipt_id",) if c in baskets.columns]
    row = F.xxhash64(*ids, *columns).alias("_row")
    data = baskets.select("period", *[X.finite_or(F.col(c), 0.0).alias(c) for c in columns], row)
    data = stage(data, "forest-rows", by="period")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    cores = spark.sparkContext.defaultParallelism

    @inheritable_thread_target(spark)
    def fit(period: str | None) -> list[tuple]:
        own = data.where(F.col("period").eqNullSafe(F.lit(period))).drop("period")
        rows = assembler.transform(own).select("features", target)
        # a small period is one file; more parts share its work, but each sends the statistics of every node
        parts = min(cores, -(-sizes[period] // FOREST_PART_ROWS))
        if rows.rdd.getNumPartitions() < parts:
            rows = rows.repartition(parts)
        forest = RandomForestRegressor(
            labelCol=target,
            numTrees=FOREST_TREES,
            featureSubsetStrategy="all",
            maxDepth=max_depth,
            maxBins=max_bins,
            maxMemoryInMB=FOREST_MEMORY_MB,
            cacheNodeIds=True,
            seed=seed,
        ).fit(rows)
        return [(period, f, float(v)) for f, v in zip(features, forest.featureImportances.toArray(), strict=True)]

    sizes = {r["period"]: r["count"] for r in data.groupBy("period").count().orderBy("period").collect()}
    few_cells = max_bins ** len(features) <= FOREST_CELLS
    large = {p: n for p, n in sizes.items() if few_cells and n >= FOREST_CELL_ROWS}
    table = []
    if large:
        found = cell_importance(data, large, features, target, FOREST_TREES, max_depth, max_bins, seed)
        table += [(p, f, float(v)) for p, values in found.items() for f, v in zip(features, values, strict=True)]
    with ThreadPoolExecutor(CONCURRENT_FITS) as pool:
        table += [row for rows in pool.map(fit, [p for p in sizes if p not in large]) for row in rows]
    place = Window.partitionBy("period").orderBy(F.desc("importance"), "feature")  # one row per feature
    ranked = spark.createDataFrame(table, _IMPORTANCE).withColumn("_place", F.row_number().over(place))
    return ranked.where(F.col("_place") <= top_n).drop("_place").orderBy("period", F.desc("importance"), "feature")


def lasso_moments(
    baskets: DataFrame, features: Sequence[str] = schema.MISSION_FEATURES, target: str = TARGET
) -> DataFrame:
    """Sums of products per fold: all the lasso needs from the data.

    Features are standardised over all rows of the period; the fold of a
    receipt comes from its id. One aggregation, a few numbers per fold.
    """
    prepared = standardize(baskets.withColumn("_y", X.finite_or(F.col(target), 0.0)), features)
    x = [F.col(f"{f}_scaled") for f in features]
    y = F.col("_y")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy")]
    for i in range(len(x)):
        aggs += [F.sum(x[i]).alias(f"x{i}"), F.sum(x[i] * y).alias(f"x{i}y")]
        aggs += [F.sum(x[i] * x[j]).alias(f"x{i}x{j}") for j in range(i, len(x))]
    fold = X.md5_bucket(F.col("receipt_id"), LASSO_FOLDS)
    return prepared.groupBy("period", fold.alias("fold")).agg(*aggs)


class _Moments:
    """Sums of products of one set of rows; sets add and subtract."""

    def __init__(self, n, sx, sxx, sxy, sy, syy):
        self.n, self.sx, self.sxx, self.sxy, self.sy, self.syy = n, sx, sxx, sxy, sy, syy

    @classmethod
    def from_row(cls, row, p: int) -> _Moments:
        sxx = np.array([[row[f"x{min(i, j)}x{max(i, j)}"] for j in range(p)] for i in range(p)])
        sx = np.array([row[f"x{i}"] for i in range(p)])
        sxy = np.array([row[f"x{i}y"] for i in range(p)])
        return cls(row["n"], sx, sxx, sxy, row["y"], row["yy"])

    def combine(self, other: _Moments, sign: int = 1) -> _Moments:
        pairs = zip(vars(self).values(), vars(other).values(), strict=True)
        return _Moments(*[a + sign * b for a, b in pairs])

    def centered(self) -> tuple[np.ndarray, np.ndarray]:
        """Covariance matrix of x and covariance of x with y."""
        mean = self.sx / self.n
        gram = self.sxx / self.n - np.outer(mean, mean)
        return gram, self.sxy / self.n - mean * (self.sy / self.n)

    def mean_squared_error(self, w: np.ndarray, intercept: float) -> float:
        total = (
            self.syy
            - 2 * (w @ self.sxy + intercept * self.sy)
            + w @ self.sxx @ w
            + 2 * intercept * (w @ self.sx)
            + self.n * intercept**2
        )
        return total / self.n


def _descend(gram: np.ndarray, cov: np.ndarray, alpha: float, w: np.ndarray) -> np.ndarray:
    """Coordinate descent for ½·wᵀGw − cᵀw + α·|w|₁ from the start ``w``."""
    w = w.copy()
    for _ in range(1000):
        largest = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 1e-12:
                continue
            partial = cov[j] - gram[j] @ w + gram[j, j] * w[j]
            updated = np.sign(partial) * max(abs(partial) - alpha, 0.0) / gram[j, j]
            largest = max(largest, abs(updated - w[j]))
            w[j] = updated
        if largest <= 1e-6 * max(1.0, float(np.abs(w).max())):
            break
    return w


def _lasso(folds: Sequence[_Moments], p: int) -> np.ndarray | None:
    """Coefficients at the penalty of lowest mean error over the folds; ``None`` without enough rows or any relation."""
    if sum(m.n for m in folds) < LASSO_MIN_ROWS or len(folds) < 2:
        return None
    whole = folds[0]
    for m in folds[1:]:
        whole = whole.combine(m)
    gram, cov = whole.centered()
    top = float(np.abs(cov).max())
    if top <= 1e-12:
        return None
    alphas = np.geomspace(top, top * LASSO_PATH_LENGTH, LASSO_ALPHAS)
    errors = np.zeros((len(folds), LASSO_ALPHAS))
    for row, held_out in enumerate(folds):
        train = whole.combine(held_out, -1)
        train_gram, train_cov = train.centered()
        w = np.zeros(p)
        for column, alpha in enumerate(alphas):
            w = _descend(train_gram, train_cov, alpha, w)
            intercept = (train.sy - w @ train.sx) / train.n
            errors[row, column] = held_out.mean_squared_error(w, intercept)
    chosen = alphas[int(errors.mean(axis=0).argmin())]
    w = np.zeros(p)
    for alpha in alphas[alphas >= chosen]:
        w = _descend(gram, cov, alpha, w)
    return w


def lasso_importance(
    baskets: DataFrame, features: Sequence[str] = schema.MISSION_FEATURES, target: str = TARGET
) -> DataFrame:
    """Coefficients of each period's cross-validated lasso that are not negligible.

    The penalty with the lowest mean error over the folds is refitted on all rows of the period.
    One aggregation gives the sums of all periods and folds, and only those reach the driver.
    """
    by_period: dict[str | None, list[_Moments]] = {}
    for row in lasso_moments(baskets, features, target).orderBy("period", "fold").collect():
        by_period.setdefault(row["period"], []).append(_Moments.from_row(row, len(features)))
    kept = []
    for period, folds in by_period.items():
        w = _lasso(folds, len(features))
        if w is not None:
            found = zip(features, w, strict=True)
            kept += [(period, f, float(v)) for f, v in found if abs(v) > LASSO_MIN_COEFFICIENT]
    return baskets.sparkSession.createDataFrame(kept, "period string, feature string, coefficient double")


def consensus_features(forest: DataFrame, lasso: DataFrame) -> DataFrame:
    """Features both models of a period name, scored 0-100, best first. Tables without ``period`` are of one."""
    keys = [c for c in ("period",) if c in forest.columns and c in lasso.columns]
    group = Window.partitionBy(*keys)  # one row per feature
    a = forest.withColumn("_top", F.max("importance").over(group))
    b = lasso.withColumn("_strength", F.abs("coefficient")).withColumn("_strongest", F.max("_strength").over(group))
    b = b.withColumnsRenamed({k: f"_r_{k}" for k in ("period", "feature")})
    same = F.col("feature") == F.col("_r_feature")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    score = F.col("importance") / F.col("_top") * 50 + F.col("_strength") / F.col("_strongest") * 50
    return (
        a.join(b, same)
        .select(*keys, "feature", F.round(score, 2).alias("consensus_score"))
        .orderBy(*keys, F.desc("consensus_score"), "feature")
    )


def exact_sample(rows: DataFrame, key: str, fraction: float, floor: int = VIF_SAMPLE_FLOOR, seed: int = 42) -> DataFrame:
    """Of each period the rows with the smallest hashes of ``key``: ``fraction`` of them, at least ``floor`` (or all).

    The hash at the sample's size is found as an order statistic, so no task sorts a period.
    """
    drawn = rows.withColumn("_draw", X.hash_fraction(F.col(key), F.lit(seed)))
    size = lambda n: F.greatest(F.least(n, F.lit(floor)), F.floor(n * F.lit(fraction)))
    last = Pick(low=size, high=size, blend=lambda low, high, n: low)
    cut = group_quantiles(drawn, ["period"], "_draw", {"_cut": last}).drop("n")
    return attach_per_period(drawn, cut).where(F.col("_draw") <= F.col("_cut")).drop("_draw", "_cut")


def vif(
    baskets: DataFrame,
    features: Sequence[str] = schema.MISSION_FEATURES,
    sample_fraction: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Variance inflation factor of each feature in each period, over rows finite in all of them.

    By default all rows count; ``sample_fraction`` keeps a hash sample of a period's receipts, 100 of them at least (see
    ``exact_sample``). The factors are the diagonal of the inverse correlation matrix.
    One aggregation gives the correlations of all periods. A period of too few rows has no factors.
    """
    usable = baskets if sample_fraction is None else exact_sample(baskets, "receipt_id", sample_fraction, seed=seed)
    for f in features:
        usable = usable.where(X.is_finite(F.col(f)))
    usable = usable.select("period", *[X.as_double(F.col(f)).alias(f) for f in features])
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i)]
    moments = usable.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.corr(features[i], features[j]).alias(f"r{i}_{j}") for i, j in pairs],
    )
    rows = []
    for row in moments.orderBy("period").collect():
        if row["n"] < p + 1:
            continue
        corr = np.eye(p)
        for i, j in pairs:
            value = row[f"r{i}_{j}"]
            corr[i, j] = corr[j, i] = np.nan if value is None else value
        if not np.isfinite(corr).all():
            factors = [None] * p  # a constant feature has no correlation
        elif abs(np.linalg.det(corr)) < 1e-14:
            factors = [float("inf")] * p
        else:
            factors = [float(v) for v in np.diag(np.linalg.inv(corr))]
        rows += [
            (row["period"], f, v, None if v is None else "PASS" if v < VIF_LIMIT else "HIGH COLLINEARITY")
            for f, v in zip(features, factors, strict=True)
        ]
    return baskets.sparkSession.createDataFrame(rows, "period string, feature string, vif double, status string")
