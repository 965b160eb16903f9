from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conftest import rows_of
from tillscope import schema
from tillscope.operators import forests, missions, outliers, selection
from tillscope.functions import exprs as X
from tillscope.operators import clusters
from tillscope.operators.clusters import kmeans_restarts
from tillscope.operators.missions import MissionModel

FEATURES = schema.MISSION_FEATURES
BASKET = "period string, receipt_id string, basket_size long, basket_value_per_item double, freshness_weight_ratio double, basket_value double"


def basket(i, size, item, fresh, period="p"):
    return (period, f"r{i}", size, item, fresh, size * item)


@pytest.fixture(scope="module")
def trips(spark):
    """Four well separated kinds of receipts and two bulk ones."""
    rng = np.random.default_rng(0)
    kinds = [(1, 5.0, 0.0), (2, 60.0, 0.1), (4, 8.0, 0.9), (9, 6.0, 0.4)]
    rows = []
    for i in range(400):
        size, item, fresh = kinds[i % 4]
        rows.append(basket(i, size, item + float(rng.normal(0, 0.2)), fresh + float(rng.normal(0, 0.01))))
    rows += [basket(900, 31, 2.0, 0.0), basket(901, 11, 151.0, 0.0)]
    return spark.createDataFrame(rows, BASKET)


def test_bulk_rule_boundaries(spark):
    rows = [basket(0, 30, 1.0, 0.0), basket(1, 31, 1.0, 0.0), basket(2, 11, 150.0, 0.0),
            basket(3, 11, 150.01, 0.0), basket(4, 10, 999.0, 0.0)]
    got = dict(rows_of(missions.flag_bulk(spark.createDataFrame(rows, BASKET)), "receipt_id", "shopping_mission"))
    assert [got[f"r{i}"] == schema.B2B for i in range(5)] == [False, True, False, True, False]


def test_center_names(spark):
    centers = [(15.1, 0.0, 0.0), (5.1, 0.0, 0.9), (5.0, 0.0, 0.31), (2.5, 45.1, 0.3), (2.5, 11.9, 0.3),
               (2.5, 45.0, 0.3), (2.6, 50.0, 0.0)]
    df = spark.createDataFrame(centers, "s double, v double, f double")
    names = [r[0] for r in df.select(missions.center_name(F.col("s"), F.col("v"), F.col("f"))).collect()]
    assert names == [schema.B2B, schema.STOCK_UP, schema.FRESH_PICK, schema.PREMIUM, schema.QUICK,
                     schema.STANDARD, schema.STANDARD]


def test_segmentation_finds_the_kinds(trips):
    named = missions.segment_missions(trips, n_clusters=5, centroid_space="raw")
    got = {(r["basket_size"], r["shopping_mission"]) for r in named.collect()}
    assert got == {(1, schema.QUICK), (2, schema.PREMIUM), (4, schema.FRESH_PICK), (9, schema.STOCK_UP),
                   (31, schema.B2B), (11, schema.B2B)}


def test_segmentation_ignores_partitioning(trips):
    want = rows_of(missions.segment_missions(trips.repartition(1)), "receipt_id", "shopping_mission")
    got = rows_of(missions.segment_missions(trips.repartition(17)), "receipt_id", "shopping_mission")
    assert got == want


def test_model_reuse_and_small_inputs(spark, trips):
    model = missions.fit_missions(trips.where(~missions.bulk_rule()))
    assert len(model.centers) == 5
    again = missions.segment_missions(trips, model=model)
    assert rows_of(again, "receipt_id", "shopping_mission") == rows_of(
        missions.segment_missions(trips), "receipt_id", "shopping_mission"
    )
    for rows in ([basket(0, 2, 3.0, 0.1)], [basket(i, 2, 3.0, 0.1) for i in range(5)]):
        named = missions.segment_missions(spark.createDataFrame(rows, BASKET))
        assert named.where("shopping_mission = 'PENDING' or shopping_mission is null").count() == 0
    only_bulk = spark.createDataFrame([basket(0, 40, 3.0, 0.1)], BASKET)
    assert missions.segment_missions(only_bulk).first()["shopping_mission"] == schema.B2B
    assert missions.segment_missions(only_bulk.where("false")).count() == 0


def test_periods_get_their_own_models(spark, trips):
    both = trips.unionByName(
        trips.withColumn("period", F.lit("q")).withColumn("basket_value_per_item", F.col("basket_value_per_item") * 3)
    )
    named = missions.segment_missions(both, n_clusters=5)
    alone = missions.segment_missions(trips, n_clusters=5)
    assert rows_of(named.where("period = 'p'"), "receipt_id", "shopping_mission") == rows_of(
        alone, "receipt_id", "shopping_mission"
    )


def test_periods_share_passes_and_keep_null(spark, trips, monkeypatch):
    passes = []
    run = clusters._pass
    monkeypatch.setattr(clusters, "_pass", lambda *a: passes.append(1) or run(*a))
    price = F.col("basket_value_per_item")
    years = [trips.withColumns({"period": F.lit(p).cast("string"), "basket_value_per_item": price * n})
             for n, p in enumerate(["1997", None, "1998", "1999"], 1)]
    alone = [missions.segment_missions(y, n_clusters=5) for y in years]
    most = max(_passes(passes, one) for one in alone)
    together = missions.segment_missions(reduce(DataFrame.unionByName, years), n_clusters=5)
    assert _passes(passes, together) <= most + 1  # not the sum
    for n, (year, one) in enumerate(zip(["1997", None, "1998", "1999"], alone)):
        own = together.where(F.col("period").eqNullSafe(F.lit(year)))
        assert rows_of(own, "receipt_id", "shopping_mission") == rows_of(one, "receipt_id", "shopping_mission")
    assert len({r[0] for r in together.where("period is null").select("shopping_mission").collect()}) > 2


def _passes(counted, df):
    """Passes that were made since the last call; fits are made when ``df`` is built."""
    n = len(counted)
    counted.clear()
    return n


def test_kmeans_against_mllib(spark):
    rng = np.random.default_rng(11)
    size, item = rng.integers(1, 12, 6000), rng.lognormal(3, 0.7, 6000)
    rows = [basket(i, int(s), float(v), float(f), "pq"[i % 2]) for i, (s, v, f) in enumerate(zip(size, item, rng.random(6000)))]
    df = spark.createDataFrame(rows, BASKET)
    curve = missions.elbow_curve(df, max_k=5).toPandas().set_index(["period", "k"])["wcss"]
    for period in "pq":
        scaled = missions.standardize(df.where(F.col("period") == period), FEATURES)
        points = VectorAssembler(inputCols=[f"{f}_scaled" for f in FEATURES], outputCol="features").transform(scaled).cache()
        for k in (3, 5):
            best = min(KMeans(k=k, seed=s, maxIter=50).fit(points).summary.trainingCost for s in range(2))
            assert curve[period, k] <= 1.01 * best


def test_saved_models_serve_other_periods(spark, trips, tmp_path):
    pending = trips.where(~missions.bulk_rule())
    other = pending.withColumns({"period": F.lit("r"), "basket_value_per_item": F.col("basket_value_per_item") * 9})
    missions.save_models(missions.fit_period_models(pending.unionByName(other)), str(tmp_path / "models"))
    models = missions.load_models(spark, str(tmp_path / "models"))
    assert rows_of(models, "period") == [("p",), ("r",)]
    for period, model in (("a", "p"), ("p", "p"), ("q", "p"), ("r", "r"), ("z", "r"), (None, "p")):
        later = trips.withColumn("period", F.lit(period).cast("string"))
        own = missions.MissionModel.from_row(models.where(F.col("period") == model).first())
        got = rows_of(missions.segment_missions(later, model=models), "receipt_id", "shopping_mission")
        assert got == rows_of(missions.segment_missions(later, model=own), "receipt_id", "shopping_mission")
    nothing = missions.segment_missions(trips, model=models.where("false"))
    assert {r[0] for r in nothing.select("shopping_mission").distinct().collect()} == {schema.B2B, schema.STANDARD}


def test_kmeans_cost_is_that_of_its_centres(trips):
    cost, centers = kmeans_restarts(trips, [F.col("basket_value_per_item")], "receipt_id", [3], 4, 1)[3]
    v = np.array([r[0] for r in trips.select("basket_value_per_item").collect()])
    assert cost == pytest.approx(((v[:, None] - centers[:, 0]) ** 2).min(axis=1).sum(), rel=1e-9)


@pytest.mark.parametrize("features", [1, 3, 5])
def test_tiles_add_up_like_points(monkeypatch, features):
    rng = np.random.default_rng(features)
    x = np.sort(rng.integers(-9, 9, (5000, features)) / 4.0, axis=0) * 1e3 + 1e6
    centers = np.vstack([x[::700], x[::700] + 0.5, x[:1]])  # points half-way between centres, and a centre twice
    label = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
    worked = []
    plain = clusters._nearest
    monkeypatch.setattr(clusters, "_nearest", lambda x, c: worked.append(len(x)) or plain(x, c))
    got = clusters._Tiles(x).sums(centers)
    assert list(got[:, 0]) == list(np.bincount(label, minlength=len(centers)))
    cost = ((x - centers[label]) ** 2).sum(axis=1)
    assert got[:, 1] == pytest.approx(np.bincount(label, cost, len(centers)), rel=1e-9, abs=1e-3)
    for i in range(features):
        assert got[:, 2 + i] == pytest.approx(np.bincount(label, x[:, i], len(centers)), rel=1e-12)
    centers, worked[:] = np.array([x.min(axis=0), x.max(axis=0)]), []
    clusters._Tiles(x).sums(centers)
    assert sum(worked) < 1000  # not all points


def test_passes_read_few_rows(spark):
    rows = spark.range(20_000, numPartitions=2).select(
        F.lit(0).alias("p"), *[X.hash_fraction(F.col("id"), F.lit(i)).alias(f"x{i}") for i in range(2)]
    )
    packed = clusters._packed(rows, ["x0", "x1"])
    assert packed.count() <= 4
    centers = np.array([[0.2, 0.2], [0.8, 0.8]])
    sums = clusters._pass(packed, ["x0", "x1"], [clusters._Fit(0, 2, centers)]).sort_values("center")
    x = rows.select("x0", "x1").toPandas().to_numpy()
    label, cost = clusters._nearest(x, centers)
    assert list(sums["n"]) == list(np.bincount(label)) and sums["cost"].sum() == pytest.approx(cost.sum())


def test_kmeans_candidates_stay_few(spark):
    rows = spark.range(100_000)
    points = rows.select(
        X.hash_fraction(F.col("id"), F.lit(1)).alias("x0"),
        X.hash_fraction(F.col("id"), F.lit(2)).alias("x1"),
        X.hash_fraction(F.col("id"), F.lit(3)).alias("draw"),
        F.lit(0).alias("p"),
    )
    found, weights = clusters._candidates(points, ["x0", "x1"])[0]
    expected = clusters.OVERSAMPLING_ROUNDS * clusters.OVERSAMPLE
    assert 0.8 * expected < len(found) < 1.2 * expected
    assert weights.sum() == 100_000


def test_elbow(spark, trips):
    curve = missions.elbow_curve(trips, max_k=5, n_init=3).toPandas()
    assert list(curve["k"]) == [2, 3, 4, 5] and curve["wcss"].is_monotonic_decreasing
    assert set(curve["recommended_k"]) == {6}
    assert missions.elbow_curve(trips.limit(2)).count() == 0


def test_standardize_keeps_constant_features(spark):
    df = spark.createDataFrame([basket(i, 4, float(i), float("inf")) for i in range(5)], BASKET)
    out = missions.standardize(df, FEATURES).toPandas()
    assert set(out["basket_size_scaled"]) == {0.0} and set(out["freshness_weight_ratio_scaled"]) == {0.0}
    assert out["basket_value_per_item_scaled"].std(ddof=0) == pytest.approx(1.0)


def test_insights_and_bulk_audit(trips):
    named = missions.flag_bulk(trips)
    got = missions.mission_insights(named).collect()
    assert sum(r["traffic_share_pct"] for r in got) == pytest.approx(100, abs=0.01)
    assert [r["revenue_share_pct"] for r in got] == sorted((r["revenue_share_pct"] for r in got), reverse=True)
    values = trips.toPandas()["basket_value"]
    for r in missions.bulk_audit(named).collect():
        assert r["anomaly_score"] == pytest.approx((r["basket_value"] - values.mean()) / values.std())


@pytest.fixture(scope="module")
def linear_baskets(spark):
    rng = np.random.default_rng(8)
    size, item, fresh = rng.integers(1, 9, 500), rng.normal(20, 3, 500), rng.random(500)
    rows = [("p", f"r{i}", int(s), float(v), float(f), float(30 * s + 2 * v)) for i, (s, v, f) in
            enumerate(zip(size, item, fresh))]
    return spark.createDataFrame(rows, BASKET)


def test_forest_importance(linear_baskets):
    got = selection.rf_importance(linear_baskets).collect()
    assert [r["feature"] for r in got][:2] == ["basket_size", "basket_value_per_item"]
    assert sum(r["importance"] for r in got) == pytest.approx(1.0)
    assert selection.rf_importance(linear_baskets, top_n=1).count() == 1
    assert selection.rf_importance(linear_baskets.where("false")).count() == 0


def _large_forest(monkeypatch):
    def refused(*a, **k):
        raise AssertionError("a large period was fitted from its rows")

    monkeypatch.setattr(selection, "FOREST_CELL_ROWS", 1)
    monkeypatch.setattr(selection, "RandomForestRegressor", refused)


def test_large_periods_are_fitted_from_cells(spark, linear_baskets, monkeypatch):
    other = linear_baskets.withColumns({"period": F.lit(None).cast("string"), "basket_value": F.col("freshness_weight_ratio") * 7})
    both = linear_baskets.unionByName(other)
    want = {(r["period"], r["feature"]): r["importance"] for r in selection.rf_importance(both, max_depth=4).collect()}
    _large_forest(monkeypatch)
    got = selection.rf_importance(both, max_depth=4).collect()
    assert {(r["period"], r["feature"]): r["importance"] for r in got} == pytest.approx(want, abs=0.02) and len(got) == 6
    again = selection.rf_importance(both.repartition(7), max_depth=4).collect()
    assert {(r["period"], r["feature"]): r["importance"] for r in again} == pytest.approx(
        {(r["period"], r["feature"]): r["importance"] for r in got}, rel=1e-9
    )
    constant = selection.rf_importance(linear_baskets.withColumn("basket_value", F.lit(1.1))).collect()
    assert [r["importance"] for r in constant] == [0.0, 0.0, 0.0]


def test_tree_of_cells_against_a_plain_tree():
    def plain(x, w, y, depth):
        found = np.zeros(x.shape[1])
        square = lambda k: (w[k] @ y[k]) ** 2 / w[k].sum()
        best = (1e-9, None, None)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                gain = square(left) + square(~left) - (w @ y) ** 2 / w.sum()
                best = max(best, (gain, f, cut), key=lambda b: b[0])
        if depth and best[1] is not None:
            found[best[1]] += best[0]
            for k in (x[:, best[1]] <= best[2], x[:, best[1]] > best[2]):
                found += plain(x[k], w[k], y[k], depth - 1)
        return found

    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 8, (200, 3)), axis=0)
    w, y = rng.integers(1, 4, len(x)).astype(float), x[:, 0] * 5.0 + x[:, 1] ** 2 + rng.normal(0, 3, len(x))
    assert forests.grow(list(x.T), w, w * y, 8, 5) == pytest.approx(plain(x, w, y, 5), rel=1e-9)


def test_bootstrap_samples_and_bins():
    drawn = forests.sample_weights(np.arange(-20_000, 20_000), 20, 42)
    chances = np.exp(-1) / np.array([1, 1, 2, 6, 24])
    assert np.bincount(drawn.ravel())[:5] / drawn.size == pytest.approx(chances, abs=3e-3)
    assert np.abs(np.corrcoef(drawn.T) - np.eye(20)).max() < 0.03
    assert list(forests.bin_cuts(np.array([3.0, 1.0, 1.0, 2.0]), 128)) == [1.5, 2.5]
    assert list(forests.bin_cuts(np.array([4.0]), 128)) == []
    values = np.random.default_rng(1).lognormal(size=10_000)
    counts = np.bincount(np.searchsorted(forests.bin_cuts(values, 128), values))
    assert len(counts) == 128 and counts.min() >= 77 and counts.max() <= 80


def test_lasso_recovers_the_linear_model(linear_baskets):
    got = {r["feature"]: r["coefficient"] for r in selection.lasso_importance(linear_baskets).collect()}
    data = linear_baskets.toPandas()
    assert got["basket_size"] == pytest.approx(30 * data["basket_size"].std(ddof=0), rel=0.01)
    assert got["basket_value_per_item"] == pytest.approx(2 * data["basket_value_per_item"].std(ddof=0), rel=0.05)
    assert abs(got.get("freshness_weight_ratio", 0.0)) < 0.2
    assert selection.lasso_importance(linear_baskets.limit(4)).count() == 0
    constant = linear_baskets.withColumn("basket_value", F.lit(1.0))
    assert selection.lasso_importance(constant).count() == 0


def test_lasso_moments_add_up(linear_baskets):
    parts = selection.lasso_moments(linear_baskets).toPandas()
    assert parts["n"].sum() == 500 and set(parts["fold"]) <= set(range(5))
    data = linear_baskets.toPandas()
    x = [((data[f] - data[f].mean()) / data[f].std(ddof=0)).to_numpy() for f in FEATURES]
    assert parts["x0x2"].sum() == pytest.approx((x[0] * x[2]).sum())
    assert parts["x1y"].sum() == pytest.approx((x[1] * data["basket_value"]).sum())


def test_consensus(spark):
    forest = spark.createDataFrame([("a", 0.6), ("b", 0.3), ("c", 0.1)], "feature string, importance double")
    lasso = spark.createDataFrame([("a", -5.0), ("b", 10.0), ("d", 1.0)], "feature string, coefficient double")
    got = [tuple(r) for r in selection.consensus_features(forest, lasso).collect()]
    assert got == [("a", 75.0), ("b", 75.0)]
    assert selection.consensus_features(forest, lasso.where("false")).count() == 0


def test_vif(spark, linear_baskets):
    data = linear_baskets.withColumn("twin", F.col("basket_size") * 2 + F.pow("freshness_weight_ratio", F.lit(3)))
    names = [*FEATURES, "twin"]
    got = {r["feature"]: r for r in selection.vif(data, names).collect()}
    corr = data.toPandas()[names].corr().to_numpy()
    for f, want in zip(names, np.diag(np.linalg.inv(corr))):
        assert got[f]["vif"] == pytest.approx(want, rel=1e-6)
    assert got["twin"]["status"] == "HIGH COLLINEARITY" and got["basket_value_per_item"]["status"] == "PASS"
    copy = linear_baskets.withColumn("twin", F.col("basket_size") * 2)
    assert {r["vif"] for r in selection.vif(copy, ["basket_size", "twin"]).collect()} == {float("inf")}
    dirty = linear_baskets.unionByName(linear_baskets.limit(1).withColumn("freshness_weight_ratio", F.lit(float("nan"))))
    assert rows_of(selection.vif(dirty), "feature", "vif") == rows_of(selection.vif(linear_baskets), "feature", "vif")
    assert selection.vif(linear_baskets.limit(3)).count() == 0
    sampled = selection.vif(linear_baskets, sample_fraction=0.5)
    assert sampled.count() == 3


def test_models_of_several_periods(spark, linear_baskets, monkeypatch):
    monkeypatch.setattr(selection, "FOREST_TREES", 5)
    other = linear_baskets.withColumns({"period": F.lit(None).cast("string"), "basket_value": F.col("freshness_weight_ratio") * 7})
    both = linear_baskets.unionByName(other)
    for model, value in ((selection.lasso_importance, "coefficient"), (selection.vif, "vif"), (selection.rf_importance, "importance")):
        got = model(both)
        for part, period in ((linear_baskets, "p"), (other, None)):
            own = {r["feature"]: r[value] for r in got.collect() if r["period"] == period}
            assert own == pytest.approx({r["feature"]: r[value] for r in model(part).collect()}) and own
    top = {r["period"]: r["feature"] for r in selection.rf_importance(both, top_n=1).collect()}
    assert top == {"p": "basket_size", None: "freshness_weight_ratio"}
    agreed = selection.consensus_features(selection.rf_importance(both), selection.lasso_importance(both)).collect()
    assert {r["feature"] for r in agreed if r["period"] is None} == {"freshness_weight_ratio"}


@pytest.mark.parametrize("fraction,want", [(0.1, 100), (0.5, 250), (1.0, 500)])
def test_samples_have_an_exact_size(linear_baskets, fraction, want):
    both = linear_baskets.unionByName(linear_baskets.limit(30).withColumn("period", F.lit(None).cast("string")))
    sample = selection.exact_sample(both, "receipt_id", fraction)
    assert {r["period"]: r["count"] for r in sample.groupBy("period").count().collect()} == {"p": want, None: 30}
    again = selection.exact_sample(both.repartition(7), "receipt_id", fraction)
    assert rows_of(sample, "period", "receipt_id") == rows_of(again, "period", "receipt_id")


def test_path_constant():
    assert list(outliers.path_constant(np.array([1, 2]))) == [0.0, 1.0]
    assert outliers.path_constant(256) == pytest.approx(10.2448, abs=1e-3)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    data = pd.DataFrame(rng.normal(0, 1, (3000, 2)), columns=["a", "b"])
    data.loc[:9] = rng.normal(9, 0.1, (10, 2))
    data.insert(0, "receipt_id", [f"r{i}" for i in range(len(data))])
    data.insert(0, "period", "p")
    return spark.createDataFrame(data)


def test_forests_of_all_periods_in_the_same_jobs(spark, cloud):
    def jobs(df):
        spark.sparkContext.setJobGroup("forest", "")
        outliers.anomaly_score(df, ["a", "b"])
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest"))
        spark.sparkContext.setJobGroup(f"other{found}", "")
        return found

    small = cloud.where("receipt_id < 'r2'")
    years = small.withColumn("period", F.when(F.length("receipt_id") > 3, F.concat(F.lit("y"), F.substring("receipt_id", 4, 1))))
    one = jobs(small.withColumn("period", F.lit("p")))
    assert years.select("period").distinct().count() == 11 and jobs(years) - one <= one


def test_given_trees_by_hand(spark):
    forest = outliers.IsolationForests(
        ("a", "b"), (4, 4), np.array([[0], [1]]), np.array([[2.0], [5.0]]), np.array([[1.0, 3.0], [2.0, 4.0]])
    )
    df = spark.createDataFrame([(0, 1.0, 9.0), (0, 3.0, 9.0), (1, 9.0, 5.0), (1, 9.0, 5.5), (None, 1.0, 1.0)], "f int, a double, b double")
    got = [r[0] for r in df.select(forest.score(F.col("f"))).coalesce(1).collect()]
    mean = float(outliers.path_constant(4))
    assert got[:4] == pytest.approx([-(2 ** (-d / mean)) for d in (1.0, 3.0, 2.0, 4.0)]) and got[4] is None


def test_planted_outliers_rank_first(cloud):
    scored = outliers.anomaly_score(cloud, ["a", "b"]).toPandas().sort_values("anomaly_score")
    assert set(scored.head(10)["receipt_id"]) == {f"r{i}" for i in range(10)}
    assert scored["anomaly_score"].iloc[0] < 0 < scored["anomaly_score"].median()
    assert scored["anomaly_score"].between(-0.5, 0.5).all()


def test_forest_ignores_partitioning(cloud):
    want = rows_of(outliers.anomaly_score(cloud.repartition(1), ["a", "b"]), "receipt_id", "anomaly_score")
    got = rows_of(outliers.anomaly_score(cloud.repartition(17), ["a", "b"]), "receipt_id", "anomaly_score")
    assert got == want


def test_forest_edges(spark, cloud):
    assert outliers.anomaly_score(cloud, []).where("anomaly_score is not null").count() == 0
    assert outliers.anomaly_score(cloud.where("false"), ["a"]).count() == 0
    same = cloud.limit(20).withColumn("a", F.lit(1.0))
    assert outliers.anomaly_score(same, ["a"]).select("anomaly_score").distinct().count() == 1


def test_each_period_has_its_own_forest(cloud):
    shifted = cloud.withColumn("period", F.lit("q")).withColumn("a", F.col("a") * 50 + 1000)
    both = outliers.anomaly_score(cloud.unionByName(shifted), {"p": ["a", "b"], "q": []})
    alone = outliers.anomaly_score(cloud, ["a", "b"])
    assert rows_of(both.where("period = 'p'"), "receipt_id", "anomaly_score") == rows_of(
        alone, "receipt_id", "anomaly_score"
    )
    assert both.where("period = 'q' and anomaly_score is null").count() == 3000


def test_behavioural_outliers(spark):
    rng = np.random.default_rng(6)
    data = pd.DataFrame(rng.normal(10, 1, (100, 4)), columns=list(outliers.BEHAVIOR_FEATURES))
    data.loc[0] = 40.0
    data.insert(0, "cashier_id", [f"c{i}" for i in range(100)])
    data.insert(0, "period", "p")
    got = outliers.behavioral_outliers(spark.createDataFrame(data)).toPandas().set_index("cashier_id")
    assert got.loc["c0", "iso_outlier_score"] == -1
    assert (got["iso_outlier_score"] == -1).sum() == 5
