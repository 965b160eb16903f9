import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillscope.operators import audits, baskets


TILLS = ("till-a", "till-b", "till-c", "till-d", "till-e")


def two_line_receipts(spark):
    """Two receipts of two lines for each till, on a Saturday morning."""
    rows = [
        ("2026-03", f"{till}/{n}", till, total, weight, product, "20260307", "09:45", "north", 0, False, False, 0.0, total, 0.0)
        for till in TILLS
        for n in (1, 2)
        for total, weight, product in ((3.0, 0.25, "plums"), (9.0, None, "soap"))
    ]
    return spark.createDataFrame(
        rows,
        "period string, receipt_id string, cashier_id string, line_total double, weight double, "
        "product_id string, date_str string, time_str string, store_id string, is_discounted int, "
        "is_item_void boolean, is_abort boolean, price_delta double, avg_unit_price double, "
        "total_discounts double",
    )


def test_receipts_to_alerts(spark):
    df = baskets.basket_features(two_line_receipts(spark))
    row = df.first()
    assert (row["basket_value"], row["basket_size"], row["hour_of_day"], row["is_weekend"]) == (12.0, 2, 9, 1)
    assert row["freshness_weight_ratio"] == 0.25 / 0.250001
    status = {r["metric"]: r["status"] for r in baskets.validate_metrics(df).collect()}
    assert {m for m, s in status.items() if s != "OK"} == {
        "leakage_pct", "void_rate_per_receipt", "total_voids",
    }
    # rates 0.6 and four times 0.1: mean 0.2, squared deviations 0.16 + 4 * 0.01 over 4
    forced = df.withColumn("discount_ratio", F.when(F.col("cashier_id") == "till-d", 0.6).otherwise(0.1))
    tagged = audits.tag_cashier_sweethearting(forced).collect()
    assert len(tagged) == 10
    for r in tagged:
        suspect = r["cashier_id"] == "till-d"
        assert r["cashier_sweethearting_anomaly_score"] == (-1 if suspect else 0)
        if suspect:
            assert r["cashier_sweethearting_z_score"] == pytest.approx(0.4 / 0.05**0.5)
    assert [r["cashier_id"] for r in audits.cashier_alerts(forced).collect()] == ["till-d"]


def test_missing_header_fields(spark, make_lines):
    """A field comes from the earliest line that has it; weights that are no number don't count."""
    df = make_lines(
        {"cashier_id": None, "payment_method_code": None, "weight": float("nan"), "product_id": "x"},
        {"cashier_id": "c9", "payment_method_code": "01", "weight": 2.0, "product_id": "y", "time_str": "11:00"},
        {"cashier_id": "c9", "payment_method_code": "04", "date_str": None, "weight": None, "product_id": "z"},
    )
    row = baskets.basket_features(df).first()
    assert (row["cashier_id"], row["hour_of_day"], row["fresh_weight_sum"]) == ("c9", 10, 2.0)
    pay = {r["cashier_id"]: r["pay_code"] for r in audits.cashier_receipts(df).collect()}
    assert pay == {None: None, "c9": "01"}
    assert audits.produce_weighing_errors(df).count() == 0


def receipts(spark, rates):
    rows = [("p", f"{c}-{i}", c, r) for c, rs in rates.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "period string, receipt_id string, cashier_id string, discount_ratio double")


def test_sweethearting_edges(spark):
    def scores(rates):
        df = audits.tag_cashier_sweethearting(receipts(spark, rates))
        return {(r["cashier_id"], r["cashier_sweethearting_z_score"]) for r in df.collect()}

    assert scores({"a": [0.5, 0.5], "b": [0.9]}) == {("a", 0.0), ("b", 0.0)}  # one peer only
    assert scores({"a": [0.5, 0.5], "b": [0.5, None, 1.0]}) == {("a", 0.0), ("b", 0.0)}  # no spread
    some = scores({"a": [0.1, 0.1], "b": [0.3, 0.3], "c": [0.9], None: [0.5, 0.5]})
    assert ("c", 0.0) in some and (None, 0.0) in some  # no peers, but kept


def test_receipts_without_a_cashier_column(spark):
    df = receipts(spark, {"a": [0.5, 0.1, 0.9]}).drop("cashier_id")
    got = audits.tag_cashier_sweethearting(df).collect()
    assert {(r["cashier_id"], r["cashier_sweethearting_z_score"]) for r in got} == {("N/A", 0.0)}


def test_severity_ranks(spark):
    rows = [("a", i, float(i)) for i in range(201)] + [("b", i, -float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "period string, id int, anomaly_score double")
    got = audits.severity(df).groupBy("period", "severity").count().collect()
    counts = {(r["period"], r["severity"]): r["count"] for r in got}
    assert counts["a", "critical"] == 3 and counts["a", "warning"] == 8 and counts["a", "info"] == 190
    assert counts["b", "critical"] == 1 and counts["b", "info"] == 9
    empty = audits.severity(df.withColumn("anomaly_score", F.lit(None).cast("double")))
    assert empty.where("severity is null").count() == 211


def test_produce_against_brute_force(make_lines):
    rng = np.random.default_rng(11)
    rows = []
    for p in range(6):
        for i in range(60):
            weight = float(rng.integers(1, 9)) / 4
            price = 2.0 + p + rng.normal(0, 0.05)
            rows.append({"product_id": f"p{p}", "receipt_id": f"{p}-{i}", "weight": weight,
                         "line_total": float(price * weight)})
        rows.append({"product_id": f"p{p}", "receipt_id": f"{p}-bad", "weight": 1.0, "line_total": 60.0})
    rows += [{"product_id": "flat", "receipt_id": f"f{i}", "weight": 1.0, "line_total": 3.0} for i in range(9)]
    rows += [{"product_id": "flat", "receipt_id": "f-far", "weight": 1.0, "line_total": 90.0}]
    rows += [{"product_id": "p0", "receipt_id": "free", "weight": 1.0, "line_total": 0.0}]
    rows += [{"product_id": "p0", "receipt_id": "negative", "weight": 1.0, "line_total": -5.0}]
    df = make_lines(*rows)
    data = pd.DataFrame(rows)
    data = data[(data["weight"] > 0) & (data["line_total"] > 0)]
    data["u"] = data["line_total"] / data["weight"]
    data["d"] = (data["u"] - data.groupby("product_id")["u"].transform("median")).abs()
    mad = data.groupby("product_id")["d"].transform("median")
    want = set(data[(mad > 0) & (data["d"] / (mad * 1.4826) > 6)]["receipt_id"])
    got = audits.produce_weighing_errors(df)
    assert {r["receipt_id"] for r in got.collect()} == want and "f-far" not in want
    assert {r["scontrinoTipo"] for r in got.collect()} == {"Peso/Prezzo Errante"}
    assert audits.produce_weighing_errors(df.where("weight < 0")).columns == got.columns


def test_fingerprint_threshold_and_payment(make_lines):
    rows = [{"cashier_id": "ten", "receipt_id": f"t{i}"} for i in range(10)]
    rows += [{"cashier_id": "eleven", "receipt_id": f"e{i}", "payment_method_code": "01" if i < 4 else "02",
              "is_abort": i == 0, "is_item_void": i < 2} for i in range(11)]
    rows += [{"cashier_id": "eleven", "receipt_id": "e10", "payment_method_code": "01", "time_str": "11:00"}]
    got = audits.cashier_fingerprint(make_lines(*rows)).collect()
    assert len(got) == 1
    row = got[0]
    assert (row["cashier_id"], row["total_transactions"]) == ("eleven", 11)
    assert row["avg_transaction_value"] == pytest.approx(120 / 11)
    assert row["void_rate_per_receipt"] == pytest.approx(2 / 11)
    assert row["abort_rate"] == pytest.approx(1 / 11)
    assert row["cash_reliance_ratio"] == pytest.approx(4 / 11)  # the earliest line decides


def test_risk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    cols = list(audits.RISK_WEIGHTS)
    data = pd.DataFrame(rng.random((30, 4)), columns=cols)
    data.insert(0, "cashier_id", [f"c{i}" for i in range(30)])
    data.insert(0, "period", "p")
    got = audits.behavioral_risk(spark.createDataFrame(data)).toPandas().set_index("cashier_id")["risk_score"]
    want = sum(
        w * ((data[c] - data[c].mean()) / (data[c].std() + 1e-6)).abs() for c, w in audits.RISK_WEIGHTS.items()
    )
    assert np.allclose(got.loc[data["cashier_id"]].to_numpy(), want.to_numpy())
    single = audits.behavioral_risk(spark.createDataFrame(data.head(1))).first()
    assert single["risk_score"] == 0.0
    report = audits.risk_report(audits.behavioral_risk(spark.createDataFrame(data))).toPandas()
    assert len(report) == (want > 0.5).sum() and report["risk_score"].is_monotonic_decreasing


def test_margin_leakage(make_lines):
    df = make_lines(
        {"cashier_id": "a", "line_total": 8.0, "total_discounts": 2.0, "is_item_void": True},
        {"cashier_id": "a", "line_total": 2.0, "total_discounts": None},
        {"cashier_id": "zero", "line_total": 0.0, "total_discounts": 1.0},
    )
    got = {r["cashier_id"]: r for r in audits.margin_leakage(df).collect()}
    assert got["a"][2:] == (2.0, 1, 10.0, 0.2)
    assert got["zero"]["leakage_pct"] is None
