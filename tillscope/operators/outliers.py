"""Isolation forests over receipts or cashiers, one for each period, grown and scored in Spark tasks.

Trees see small row samples, so growing them is cheap at any data size: hashes
of the row id and the tree pick the rows of every tree of every period in one scan, and
all trees grow in parallel. A forest is bounded by the number of
trees and their depth; one vectorised pass over the rows scores each by the forest of its period.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions import exprs as X
from tillscope.functions.lookup import attach_per_period
from tillscope.functions.quantiles import group_quantiles, linear
from tillscope.operators.missions import periods_of
from tillscope.session import stage

# Tasks get the functions below by value; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Trees, rows per tree and the offset of the automatic cut.
TREES = 100
TREE_ROWS = 256
AUTO_OFFSET = -0.5
# Fixed value: expected share of outliers among cashiers.
CASHIER_CONTAMINATION = 0.05
BEHAVIOR_FEATURES = (
    "avg_transaction_value",
    "void_rate_per_receipt",
    "abort_rate",
    "cash_reliance_ratio",
)

_EULER_GAMMA = 0.5772156649015329
_TREE = "forest int, tree int, feature array<int>, threshold array<double>, depths array<double>"
# Rows scored together; all trees of their forests are walked at once.
_SCORED_ROWS = 1024


def path_constant(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0) - 1.0
    formula = 2.0 * (np.log(big) + _EULER_GAMMA) - 2.0 * big / np.maximum(n, 3.0)
    return np.where(n > 2, formula, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, seed: int, levels: int, most: int | None = None) -> tuple[np.ndarray, ...]:
    """One tree in heap order: features and thresholds of the inner nodes, leaf depths.

    A branch that ends early, or after ``most`` levels, runs on to the last level without splitting, so
    that every row takes the same number of steps.
    """
    rng = np.random.default_rng(seed)
    most = levels if most is None else most
    inner = (1 << levels) - 1
    feature, threshold = np.zeros(inner, dtype=int), np.full(inner, np.inf)
    depths = np.zeros(1 << levels)
    pending = [(points, 0, 0)]
    while pending:
        rows, node, depth = pending.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth == most or len(splittable) == 0:
            for _ in range(levels - depth):
                node = 2 * node + 1
            depths[node - inner] = depth + path_constant(len(rows))
            continue
        chosen = int(rng.choice(splittable))
        cut = float(rng.uniform(low[chosen], high[chosen]))
        cut = min(cut, float(np.nextafter(high[chosen], low[chosen])))
        feature[node], threshold[node] = chosen, cut
        right = rows[:, chosen] > cut
        pending += [(rows[right], 2 * node + 2, depth + 1), (rows[~right], 2 * node + 1, depth + 1)]
    return feature, threshold, depths


@dataclass(frozen=True)
class IsolationForests:
    """Forests of the same number of trees in heap order, and the sample size behind each.

    ``feature``, ``threshold`` and ``depths`` have one row for each tree: those of the first forest, then of the next. Splits
    name features by their place in ``features``, whichever of them a forest uses.
    """

    features: tuple[str, ...]
    tree_rows: tuple[int, ...]
    feature: np.ndarray
    threshold: np.ndarray
    depths: np.ndarray

    def score(self, forest: Column | None = None) -> Column:
        """Minus the anomaly score in (0, 1] by the ``forest`` of that number; lower is more anomalous, null without one.

        Only the feature columns travel to the Python workers.
        """
        count, width, inner = len(self.tree_rows), len(self.features), self.feature.shape[1]
        trees = len(self.feature) // count
        levels = (inner + 1).bit_length() - 1
        normal = trees * np.array([float(path_constant(n)) or 1.0 for n in self.tree_rows])
        feature, threshold, depths = self.feature.ravel(), self.threshold.ravel(), self.depths.ravel()

        def scores(points: np.ndarray, which: np.ndarray) -> np.ndarray:
            tree = which[:, None] * trees + np.arange(trees)
            first, node = np.arange(len(points))[:, None] * width, np.zeros(tree.shape, np.int64)
            values, splits = points.ravel(), tree * inner
            for _ in range(levels):
                at = splits + node
                node = 2 * node + 1 + (values.take(first + feature.take(at)) > threshold.take(at))
            total = depths.take(tree * (inner + 1) + node - inner).sum(axis=1)
            return -np.power(2.0, -total / normal[which])

        @F.pandas_udf("double")
        def negative_score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for batch in batches:
                found = np.full(len(batch), np.nan)
                rows = np.flatnonzero(batch["forest"].notna().to_numpy())
                points = batch.drop(columns="forest").to_numpy(dtype=float)
                which = batch["forest"].fillna(0).to_numpy(dtype=np.int64)
                for some in np.array_split(rows, -(-len(rows) // _SCORED_ROWS) or 1):
                    found[some] = scores(points[some], which[some])
                yield pd.Series(found)

        number = F.lit(0) if forest is None else forest
        inputs = [X.model_input(F.col(f)).alias(f"x{i}") for i, f in enumerate(self.features)]
        return F.when(number.isNotNull(), negative_score(F.struct(number.alias("forest"), *inputs)))


def fit_forests(
    rows: DataFrame,
    features: Mapping[int, Sequence[str]],
    id_col: str,
    forest: str,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    seed: int = 42,
) -> IsolationForests | None:
    """Grow a forest for each number in the column ``forest``, all in one scan; ``None`` without rows.

    ``features`` says which features each uses; rows of other numbers, or none, take no part. The result depends
    on row ids and the seed, not on partitioning or order.
    """
    names = sorted({f for used in features.values() for f in used})
    sizes = rows.where(F.col(forest).isin([n for n, used in features.items() if used])).groupBy(forest).count()
    count = {r[forest]: r["count"] for r in sizes.collect()}
    if not count:
        return None
    sample = [min(tree_rows, count.get(n, 0)) for n in range(max(count) + 1)]
    inputs = [X.model_input(F.col(f)).alias(f"x{i}") for i, f in enumerate(names)]
    every = rows.select(F.col(forest).alias("forest"), F.col(id_col).cast("string").alias("id"), *inputs)
    # each tree takes the rows with its smallest hashes; three times the sample
    # is expected to be under the bound, so only those are exploded and ranked
    bounds = [(n, sample[n], 3.0 * sample[n] / count[n]) for n in count]
    table = rows.sparkSession.createDataFrame(bounds, "forest int, sample int, bound double")
    every = every.join(F.broadcast(table), "forest")
    drawn = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: X.hash_fraction(F.col("id"), t, F.lit(seed)) < F.col("bound"),
    )
    picked = every.withColumn("tree", F.explode(drawn))
    picked = picked.withColumn("draw", X.hash_fraction(F.col("id"), F.col("tree"), F.lit(seed)))
    order = Window.partitionBy("forest", "tree").orderBy("draw", "id")
    picked = picked.withColumn("position", F.row_number().over(order)).where("position <= sample")
    deep = {n: int(math.ceil(math.log2(max(s, 2)))) for n, s in enumerate(sample)}
    levels = max(deep[n] for n in count)
    places = {n: [names.index(f) for f in used] for n, used in features.items()}

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        number, tree = (int(k) for k in key)
        group = group.sort_values("position")
        points = group[[f"x{i}" for i in places[number]]].to_numpy(dtype=float)
        feature, threshold, depths = _grow(points, seed * 1_000_003 + tree, levels, deep[number])
        feature = np.array(places[number])[feature]
        row = (number, tree, feature.tolist(), threshold.tolist(), depths.tolist())
        return pd.DataFrame([row], columns=["forest", "tree", "feature", "threshold", "depths"])

    # a row for each tree of each period, with fewer than 2 * tree_rows numbers per column
    grown = picked.groupBy("forest", "tree").applyInPandas(grow, _TREE).toPandas()
    inner = (1 << levels) - 1
    shape = len(sample) * trees
    feature, threshold, depths = np.zeros((shape, inner), int), np.full((shape, inner), np.inf), np.zeros((shape, inner + 1))
    for r in grown.itertuples(index=False):
        at = r.forest * trees + r.tree
        feature[at], threshold[at], depths[at] = r.feature, r.threshold, r.depths
    return IsolationForests(tuple(names), tuple(sample), feature, threshold, depths)


def _numbered(rows: DataFrame, column: str) -> tuple[list[str | None], DataFrame]:
    """The periods, and the rows with the number of theirs."""
    periods = periods_of(rows)
    table = rows.sparkSession.createDataFrame([(p, i) for i, p in enumerate(periods)], f"period string, {column} int")
    return periods, attach_per_period(rows, table)


def _scored(
    rows: DataFrame, features: Sequence[str] | Mapping[str | None, Sequence[str]], id_col: str, seed: int, out: str
) -> DataFrame:
    """Adds ``out``, minus the anomaly score by the period's forest; null for a period without features."""
    periods, numbered = _numbered(rows, "_forest")
    chosen = {i: tuple(features.get(p, ()) if isinstance(features, Mapping) else features) for i, p in enumerate(periods)}
    forests = fit_forests(numbered, chosen, id_col, "_forest", seed=seed)
    if forests is None:
        return rows.withColumn(out, F.lit(None).cast("double"))
    grown = [i for i, used in chosen.items() if used]
    number = F.when(F.col("_forest").isin(grown), F.col("_forest"))
    return numbered.withColumn(out, forests.score(number)).drop("_forest")


def anomaly_score(
    rows: DataFrame,
    features: Sequence[str] | Mapping[str | None, Sequence[str]],
    id_col: str = "receipt_id",
    seed: int = 42,
) -> DataFrame:
    """Adds ``anomaly_score``; negative means more isolated than usual.

    Each period has its own forest, and may have its own features. Without
    features or rows the score is null. ``rows`` is read several times, however many periods
    it has, so callers pass a staged table.
    """
    scored = _scored(rows, features, id_col, seed, "anomaly_score")
    return scored.withColumn("anomaly_score", F.col("anomaly_score") - F.lit(AUTO_OFFSET))


def behavioral_outliers(
    fingerprints: DataFrame,
    features: Sequence[str] = BEHAVIOR_FEATURES,
    contamination: float = CASHIER_CONTAMINATION,
    seed: int = 42,
) -> DataFrame:
    """Adds ``iso_outlier_score``: -1 for the period's most isolated cashiers, else 1."""
    scored = stage(_scored(fingerprints, features, "cashier_id", seed, "_score"), "cashier-scores")
    cut = group_quantiles(scored, ["period"], "_score", {"_cut": linear(contamination)}).drop("n")
    return (
        attach_per_period(scored, cut)
        .withColumn("iso_outlier_score", F.when(F.col("_score") < F.col("_cut"), -1).otherwise(1))
        .drop("_score", "_cut")
    )
