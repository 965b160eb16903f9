import pytest
from pyspark.sql import functions as F

from tillscope import schema
from tillscope.sources.driver_tables import raw_receipt_lines
from tillscope.operators import baskets, lines


def test_normalize_lines(spark):
    raw = spark.createDataFrame(
        [("r", "p", 1.0, None, "s", "20260205", "10:15", "c", "01", 0.0, 0.0, "Y", "y", "N", None, "1")],
        schema.RAW_SCHEMA,
    ).withColumn("period", F.lit("2026-02"))
    row = lines.normalize_lines(raw).first()
    assert (row["receipt_id"], row["line_total"], row["hour_of_day"]) == ("r", 1.0, 10)
    assert (row["is_abort"], row["is_item_void"], row["is_void"], row["is_gift"]) == (
        True, False, None, True,
    )
    with pytest.raises(ValueError, match="storno"):
        lines.normalize_lines(raw.drop("storno"))


def test_bad_times_and_dates_are_counted(make_lines):
    df = make_lines({}, {"time_str": "xx"}, {"date_str": "2026-02-05"}, {"time_str": None})
    row = lines.time_quality(df).first()
    assert row[1:] == (4, 1, 1, 1, 0)


def test_price_features(make_lines):
    df = make_lines(
        {"line_total": 1.0}, {"line_total": 3.0, "weight": 2.0}, {"line_total": 4.0}, {"line_total": 8.0},
        {"line_total": None}, {"product_id": None, "line_total": 5.0},
        {"product_id": "only-null", "line_total": None},
        {"period": "2026-03", "line_total": 100.0},
    )
    got = {(r["period"], r["product_id"], r["line_total"]): r for r in lines.line_price_features(df).collect()}
    cheap = got["2026-02", "p1", 1.0]
    assert (cheap["Standard_Price"], cheap["is_discounted"], cheap["price_delta"]) == (3.5, True, -2.5)
    assert got["2026-02", "p1", 3.0]["avg_unit_price"] == 1.5
    assert got["2026-02", "p1", 8.0]["is_discounted"] is False
    nothing = got["2026-02", "p1", None]
    assert (nothing["is_discounted"], nothing["price_delta"], nothing["avg_unit_price"]) == (False, 0.0, 0.0)
    assert got["2026-02", None, 5.0]["Standard_Price"] == 5.0  # null is a product of its own
    assert got["2026-02", "only-null", None]["Standard_Price"] is None
    assert got["2026-03", "p1", 100.0]["Standard_Price"] == 100.0  # periods stay apart


def priced(make_lines, *rows):
    return lines.line_price_features(make_lines(*rows))


def test_basket_features(make_lines):
    df = priced(
        make_lines,
        {"receipt_id": "a", "line_total": 10.0, "weight": 0.5, "time_str": "12:59", "date_str": "20260207"},
        {"receipt_id": "a", "line_total": -4.0, "is_item_void": True, "time_str": "12:59", "date_str": "20260207"},
        {"receipt_id": "a", "line_total": None, "is_item_void": None, "time_str": "12:59", "date_str": "20260207"},
        {"receipt_id": "b", "line_total": 0.0},
    )
    got = {r["receipt_id"]: r for r in baskets.basket_features(df).collect()}
    a = got["a"]
    assert (a["basket_value"], a["basket_size"], a["total_voids"], a["void_value"]) == (6.0, 3, 1, 4.0)
    assert (a["has_fresh_produce"], a["fresh_value_sum"], a["total_weight"]) == (True, 10.0, 0.5)
    assert a["freshness_weight_ratio"] == 0.5 / 0.500001
    assert a["leakage_pct"] == 4.0 / (6.0 + 4.0 + 1e-6)
    assert a["void_rate_per_receipt"] == 1 / 3
    assert (a["hour_of_day"], a["is_weekend"], a["peak_hour_pressure_numeric"]) == (12, 1, 1)
    b = got["b"]
    assert (b["is_single_item_flag"], b["basket_value_per_item"], b["freshness_value_ratio"]) == (1, 0.0, 0.0)
    assert (b["is_weekend"], b["peak_hour_pressure_numeric"], b["has_fresh_produce"]) == (0, 0, False)


def test_one_header_counts_for_a_mixed_receipt(make_lines):
    rows = [
        {"time_str": "09:00", "cashier_id": "late", "store_id": "s9"},
        {"time_str": "08:00", "cashier_id": "early", "store_id": "s1", "line_total": 2.0},
    ]
    for order in (rows, rows[::-1]):
        row = baskets.basket_features(priced(make_lines, *order)).collect()
        assert len(row) == 1
        assert (row[0]["cashier_id"], row[0]["store_id"], row[0]["hour_of_day"]) == ("early", "s1", 8)
        assert (row[0]["basket_value"], row[0]["basket_size"]) == (12.0, 2)


def test_hot_receipt_and_partitioning_do_not_matter(make_lines):
    rows = [{"receipt_id": "hot", "line_total": float(i % 7)} for i in range(300)]
    rows += [{"receipt_id": f"r{i}", "line_total": 1.0} for i in range(100)]
    df = make_lines(*rows)
    want = sorted(baskets.basket_features(lines.line_price_features(df.repartition(1))).collect())
    got = sorted(baskets.basket_features(lines.line_price_features(df.repartition(17))).collect())
    assert want == got and len(got) == 101


def test_lines_per_receipt(make_lines):
    df = make_lines({"receipt_id": "a"}, {"receipt_id": "a"}, {"receipt_id": "b"})
    assert lines.lines_per_receipt(df).first()[1:] == (2, 3, 1.5)


def test_validate_metrics(spark):
    df = spark.createDataFrame(
        [("p", 10.0, 0.5, float("inf"), 0.0, 0.0), ("p", 20.0, None, float("nan"), 0.0, 0.0)],
        "period string, basket_value double, freshness_weight_ratio double, "
        "freshness_value_ratio double, leakage_pct double, void_rate_per_receipt double",
    )
    got = {r["metric"]: r for r in baskets.validate_metrics(df).collect()}
    assert len(got) == 6
    assert (got["basket_value"]["total"], got["basket_value"]["avg"], got["basket_value"]["status"]) == (
        30.0, 15.0, "OK",
    )
    assert got["freshness_weight_ratio"]["avg"] == 0.5
    assert got["freshness_value_ratio"]["impact"] == "mission clustering"
    assert got["leakage_pct"]["impact"] == "cashier risk"
    assert got["total_voids"]["status"] == "MISSING_COLUMN"
    assert baskets.validate_metrics(df.where("false")).count() == 0


def test_missing_cashier_column(spark):
    df = spark.createDataFrame([("r",)], "receipt_id string")
    assert baskets.ensure_cashier(df).first()["cashier_id"] == "N/A"


def _exchanges(df):
    """The shuffles of a plan: each with the columns that it moves."""
    found = []
    prepared = df._jdf.queryExecution().executedPlan()
    left = [prepared.initialPlan() if prepared.nodeName() == "AdaptiveSparkPlan" else prepared]
    while left:
        node = left.pop()
        if node.nodeName() == "Exchange":
            found.append([node.output().apply(i).name() for i in range(node.output().size())])
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_receipts_are_dealt_without_wide_buffers(make_lines):
    lines = make_lines(
        {"time_str": "11:00", "store_id": "s2"}, {"time_str": "10:00", "cashier_id": None}, {"receipt_id": None, "store_id": None},
        {"receipt_id": None, "date_str": None}, {"period": None},
    )
    df = baskets.basket_features(lines)
    moved = _exchanges(df)
    # a field with the date and time of its line, for each field of the header, is put together behind the last shuffle
    assert len(moved) == 2 and all("min" not in columns for columns in moved)
    got = {(r["period"], r["receipt_id"]): (r["basket_size"], r["store_id"], r["cashier_id"], r["hour_of_day"]) for r in df.collect()}
    assert got == {
        ("2026-02", "r1"): (2, "s1", "c1", 10), ("2026-02", None): (2, "s1", "c1", 10), (None, "r1"): (1, "s1", "c1", 10),
    }


def test_lines_are_shuffled_as_cents_and_flags(spark, tmp_path):
    spark.sql(
        "select 1L o_orderkey, 2L o_custkey, timestamp'1997-01-02' o_orderdate, '1-URGENT' o_orderpriority"
    ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql(
        "select 1L l_orderkey, k l_partkey, 5D l_quantity, 10.5D l_extendedprice, d l_discount, f l_returnflag, s l_linestatus"
        " from values (4L, 0D, 'R', 'F'), (5L, 0.1D, 'R', null), (6L, null, 'N', 'F') t(k, d, f, s)"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    df = raw_receipt_lines(spark, str(tmp_path))
    moved = {c for columns in _exchanges(df) for c in columns}
    assert "totaleLordo" in moved and not moved & {"l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity"}
    got = sorted(tuple(r) for r in df.select("articoloCodice", "totaleLordo", "storno", "omaggio").collect())
    assert [(a, float(b), c, d) for a, b, c, d in got] == [("4", 10.5, "y", "1"), ("5", 10.5, "N", "0"), ("6", 10.5, "N", "0")]
