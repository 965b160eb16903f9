import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tillscope.functions import exprs as X
from tillscope.functions import quantiles
from tillscope.functions.lookup import _heavy, attach
from tillscope.functions.quantiles import group_quantiles, linear, median, nearest, range_bucket
from tillscope.session import stage


def one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_flags(spark):
    texts = [("Y",), ("y",), ("1",), ("s",), ("N",), ("1.0",), ("true",), (None,)]
    got = one(spark, texts, "v string", X.text_flag(F.col("v")))
    assert got == [True, True, True, True, False, False, False, None]
    assert one(spark, [(True,)], "v boolean", X.text_flag(F.col("v"))) == [False]
    assert one(spark, [(1,)], "v int", X.text_flag(F.col("v"))) == [True]


def test_dates_and_hours(spark):
    texts = [("20260205",), ("2026-02-05",), ("rubbish",), (None,)]
    days = one(spark, texts, "v string", X.parse_day(F.col("v")))
    assert str(days[0]) == "2026-02-05" and days[1:] == [None, None, None]
    hours = [("09:30",), ("183000",), ("xx:10",), (None,)]
    assert one(spark, hours, "v string", X.hour_prefix(F.col("v"))) == [9, 18, None, None]
    strict = [("09:30",), ("093000",), ("25:00",)]
    assert one(spark, strict, "v string", X.clock_hour(F.col("v"))) == [9, None, None]


def test_weekday_and_peak(spark):
    days = [("20260205",), ("20260207",), ("20260208",), (None,)]
    day = X.parse_day(F.col("v"))
    assert one(spark, days, "v string", X.iso_weekday(day)) == [4, 6, 7, None]
    assert one(spark, days, "v string", X.weekend_flag(day)) == [0, 1, 1, None]
    hours = [(11,), (12,), (14,), (15,), (18,), (20,), (21,), (None,)]
    assert one(spark, hours, "v int", X.peak_flag(F.col("v"))) == [0, 1, 1, 0, 1, 1, 0, 0]


def test_numeric_guards(spark):
    nan, inf = float("nan"), float("inf")
    values = [(1.5,), (nan,), (inf,), (-inf,), (None,), (5e9,)]
    v = F.col("v")
    assert one(spark, values, "v double", X.model_input(v)) == [1.5, 0.0, 0.0, 0.0, 0.0, 1e9]
    assert one(spark, values, "v double", X.fill_missing(v)) == [1.5, 0.0, inf, -inf, 0.0, 5e9]
    assert one(spark, values, "v double", X.is_finite(v)) == [True, False, False, False, False, True]
    assert one(spark, [(0.0,), (2.0,)], "v double", X.ratio(F.lit(1.0), v)) == [None, 0.5]


def test_md5_modulus_is_that_of_the_whole_digest(spark):
    keys = [(f"area=382/day={i}.parquet",) for i in range(300)]
    got = one(spark, keys, "v string", X.md5_mod(F.col("v"), 100))
    assert got == [int(hashlib.md5(k.encode()).hexdigest(), 16) % 100 for (k,) in keys]


def _groups():
    rng = np.random.default_rng(3)
    frames = [
        pd.DataFrame({"g": "cents", "v": rng.integers(-500, 500, 801) / 100}),
        pd.DataFrame({"g": "smooth", "v": rng.normal(1000, 3, 1000)}),
        pd.DataFrame({"g": None, "v": rng.lognormal(0, 4, 57)}),
        pd.DataFrame({"g": "one", "v": [7.25]}),
        pd.DataFrame({"g": "same", "v": [2.5] * 40}),
    ]
    return pd.concat(frames, ignore_index=True)


@pytest.mark.parametrize("window_values", [500_000, 300, 0])
def test_group_quantiles_against_brute_force(spark, window_values):
    data = _groups()
    rows = [(None if pd.isna(g) else g, float(v)) for g, v in zip(data["g"], data["v"])]
    rows += [("cents", None), ("cents", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    picks = {"med": median(), "q01": nearest(0.01), "q30": linear(0.3)}
    got = {
        r["g"]: r for r in group_quantiles(df, ["g"], "v", picks, window_values=window_values).collect()
    }
    assert len(got) == 5
    for key, part in data.groupby("g", dropna=False):
        key = None if pd.isna(key) else key
        v = np.sort(part["v"].to_numpy())
        assert got[key]["n"] == len(v)
        assert got[key]["med"] == pytest.approx(np.median(v), rel=1e-15)
        assert got[key]["q01"] == v[int(np.floor(0.01 * (len(v) - 1) + 0.5))]
        assert got[key]["q30"] == pytest.approx(np.percentile(v, 30), rel=1e-12)


@pytest.mark.parametrize("first", [True, False])
def test_range_buckets_never_decrease(spark, first):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 10.0**e, 200) for e in range(-6, 9)])
    for part in (v, v[v > 0], -v[v > 0], 1e6 + v[np.abs(v) < 1e-3], [0.0, 1e-300, float("inf")], [-1e308, 1e308], [2.0]):
        part = np.sort(part)
        low, high = F.lit(float(part[0])), F.lit(float(part[-1]))
        df = spark.createDataFrame([(float(x),) for x in part], "v double").coalesce(1)
        buckets = [r[0] for r in df.select(range_bucket(F.col("v"), low, high, first)).collect()]
        assert buckets == sorted(buckets) and (len(part) == 1 or buckets[0] < buckets[-1])


def test_close_values_are_cut_until_few_are_left(spark, monkeypatch):
    # 200,000 values inside 1e-9 of their size, as many tiny ones around zero, and a plain group
    rows = spark.range(200_000)
    close = rows.select(F.lit("close").alias("g"), (F.lit(1e6) + (F.col("id") * 7919 % 200_000) * 1e-9).alias("v"))
    tiny = rows.select(F.lit("tiny").alias("g"), ((F.col("id") * 104_729 % 200_000) - 100_000).cast("double").alias("v"))
    tiny = tiny.withColumn("v", F.col("v") * 1e-200)
    plain = rows.limit(1000).select(F.lit("plain").alias("g"), F.col("id").cast("double").alias("v"))
    df = close.union(tiny).union(plain)
    ranked, inside = [], quantiles._inside

    def watched(counts, ranges, keys, wanted):
        out = inside(counts, ranges, keys, wanted)
        ranked.append(out.groupBy(*keys, "_i").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "_inside", watched)
    picks = {"med": median(), "q01": nearest(0.01), "q99": linear(0.99)}
    got = {r["g"]: r for r in group_quantiles(df, ["g"], "v", picks, window_values=100).collect()}
    assert ranked[-1] <= 100
    for g, part in df.toPandas().groupby("g"):
        v = np.sort(part["v"].to_numpy())
        assert got[g]["med"] == pytest.approx(np.median(v), rel=1e-15, abs=0)
        assert got[g]["q01"] == v[int(np.floor(0.01 * (len(v) - 1) + 0.5))]
        assert got[g]["q99"] == pytest.approx(np.percentile(v, 99), rel=1e-12, abs=0)


def test_counted_values(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 9.0, 2)], "g string, v double, c long")
    row = group_quantiles(df, ["g"], "v", {"med": median()}, count="c").first()
    assert (row["n"], row["med"]) == (7, 1.0)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "task_rows": 20}])
def test_attach_is_the_same_on_every_path(spark, how, limits):
    facts = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("k"), F.col("id") % 20)
        ).alias("k"),
        "id",
    )
    lookup = spark.createDataFrame([("hot", 1), (None, 2), ("k2", 3), ("k5", 4)], "k string, x int")
    got = attach(facts, lookup, ["k"], how=how, **limits)
    table = {"hot": 1, None: 2, "k2": 3, "k5": 4}
    want = [(r["id"], table.get(r["k"])) for r in facts.collect()]
    if how == "inner":
        want = [w for w in want if w[1] is not None]
    assert rows_of(got, "id", "x") == sorted(want, key=repr)


def test_heavy_keys_are_split(spark):
    # 2,000 keys of 50 rows each, and one of a third of all rows
    facts = spark.range(150_000).select(F.when(F.col("id") < 50_000, -1).otherwise(F.col("id") % 2000).alias("k"), "id")
    lookup = spark.range(-1, 2000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("x"))
    got = attach(facts, lookup, ["k"], broadcast_bytes=0, task_rows=40)
    assert got.count() == 150_000 and got.where("x <> 3 * k or x is null").count() == 0
    heavy = _heavy(facts, ["k"], 40, 100_000)
    assert heavy.count() == 2001 and heavy.where("k = -1").first()["_parts"] == 1250
    part = F.pmod(F.xxhash64("k", "id"), F.col("_parts"))
    sizes = facts.join(heavy, "k").groupBy("k", part).count().agg(F.max("count")).first()[0]
    assert sizes < 90  # parts of about 40 rows
    # a bound on the number of split keys raises the rows of a part
    assert _heavy(facts, ["k"], 40, 2).count() == 0 and _heavy(facts, ["k"], 40, 4).count() == 1


def test_staged_tables_keep_types_and_prune(spark):
    df = spark.createDataFrame([("1997", 1, 2.5), ("1998", 2, None), (None, 3, 1.0)], "period string, n int, v double")
    back = stage(df, "t", by="period")
    assert dict(back.dtypes) == dict(df.dtypes)
    assert rows_of(back, "period", "n", "v") == rows_of(df, "period", "n", "v")
    one_period = back.where("period = '1997'").select("n")
    assert "PartitionFilters: [isnotnull(period" in one_period._jdf.queryExecution().executedPlan().toString()
    assert stage(df.where("false"), "none", by="period").count() == 0
