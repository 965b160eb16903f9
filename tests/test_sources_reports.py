import glob
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows_of
from tillscope.plans import pipeline, reports
from tillscope.plans.registry import QUERIES
from tillscope.sources import receipts
from tillscope.sources.driver_tables import raw_receipt_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    """Receipts as raw files: one area plain, one below a branch folder."""
    root = str(tmp_path_factory.mktemp("data"))
    raw = raw_receipt_lines(spark, SF).drop("period")
    day = F.to_date("scontrinoData", "yyyyMMdd")
    keyed = raw.withColumns({
        "year": F.lit(2024), "month": F.month(day) % 3 + 4, "day": F.dayofmonth(day) % 2 + 1,
    }).withColumns({"totaleLordo": F.col("totaleLordo").cast("double"),
                    "totaleSconti": F.col("totaleSconti").cast("double")})
    base = f"{root}/{receipts.LINES_FOLDER}"
    keyed.coalesce(2).write.partitionBy("year", "month", "day").parquet(f"{base}/area=382")
    keyed.coalesce(1).write.partitionBy("year", "month", "day").parquet(f"{base}/area=500/branch_x")
    return root, keyed


def test_scan_prunes_to_the_folders_asked_for(spark, layout):
    root, keyed = layout
    got = receipts.scan_period(spark, root, 2024, 4, month_end=5, day=1, area="382")
    assert got.count() == keyed.where("month in (4, 5) and day = 1").count() > 0
    assert {r[0] for r in got.select("period").distinct().collect()} == {"2024-04", "2024-05"}
    assert {os.path.dirname(f).split("/")[-1] for f in _files(got)} == {"day=1"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    whole = receipts.scan_period(spark, root, 2024, 6, area="382")
    assert whole.count() == keyed.where("month = 6").count()
    days = receipts.scan_period(spark, root, 2024, 6, day=1, day_end=2, area="382")
    assert days.count() == whole.count()


def _files(df):
    return [r[0] for r in df.select(F.input_file_name()).distinct().collect()]


def test_scan_reads_branches_and_all_areas(spark, layout):
    root, keyed = layout
    branch = receipts.scan_period(spark, root, 2024, 4, area="500")
    assert branch.count() == keyed.where("month = 4").count()
    both = receipts.scan_period(spark, root, 2024, 4)
    assert {r[0] for r in both.select("area").distinct().collect()} == {"382", "500"}
    with pytest.raises(FileNotFoundError):
        receipts.scan_period(spark, root, 1999, 4)


RAGGED = "\n".join(
    ["code;label;amount;day", "7;soap;1.20;2025-05-01", "8;plums", "9;rope;2,x;2025-05-02", "10;tea;3;2025-05-03;late;later"]
)


def test_messy_csv(spark, tmp_path):
    (tmp_path / "ragged.csv").write_text(RAGGED + "\n")
    df = receipts.read_receipts(spark, str(tmp_path))
    assert df.columns == ["code", "label", "amount", "day"] and df.count() == 4
    typed = receipts.read_csv(spark, str(tmp_path), "code string, label string, amount double, day string")
    amounts = {r["label"]: r["amount"] for r in typed.collect()}
    assert amounts == {"soap": 1.2, "plums": None, "rope": None, "tea": 3.0}


def test_problems_of_rows_and_files(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "ragged.csv").write_text(RAGGED + '\n11;"a;b";4;2025-05-04\n12;"c;d"\n')
    (tmp_path / "old" / "fine.csv").write_text("code;label;amount;day\n13;ink;5;2025-05-05\n")
    columns = T.StructType.fromDDL("code string, label string, amount double, day string")
    spark.createDataFrame([("1", "jam", 2.5, "2025-05-06")], columns).write.parquet(str(tmp_path / "new"))
    (tmp_path / "new" / "stray.csv").write_text("x;y\n1;2\n")
    rows = receipts.read_folders(spark, [str(tmp_path / "old"), str(tmp_path / "new")], columns)
    got = {r["label"]: (r["problem"], r["amount"], r["format"]) for r in rows.collect()}
    assert got == {
        "soap": (None, 1.2, "csv"), "plums": ("short", None, "csv"), "rope": ("unparseable", None, "csv"),
        "tea": ("long", 3.0, "csv"), "a;b": (None, 4.0, "csv"), "c;d": ("short", None, "csv"), "ink": (None, 5.0, "csv"),
        "jam": (None, 2.5, "parquet"),
    }
    files = {os.path.basename(r["file"]): tuple(r)[2:] for r in receipts.file_quality(rows).collect()}
    assert files["ragged.csv"] == (6, 3, 2, 1, 1) and files["fine.csv"] == (1, 1, 0, 0, 0)
    with pytest.raises(FileNotFoundError):
        receipts.read_folders(spark, [str(tmp_path / "none")], columns)


def test_layout_query_opens_only_the_folders_asked_for(spark):
    got = QUERIES["scan_layout"](spark, SF)
    folders = {os.path.dirname(f).split(receipts.LINES_FOLDER + "/")[1] for f in _files(got)}
    assert folders <= {
        f"{area}/year=1997/month={m}/day=1" for area in ("area=382", "area=500/north/inner") for m in (3, 4, 5)
    }
    assert {f.split("/")[0] for f in folders} == {"area=382", "area=500"}


def test_period_documents(spark, tmp_path):
    a = spark.createDataFrame([("x", "1", 0.5), ("x", "2", 0.7), (None, "3", 0.1)], ["periodo", "Codice Cassiere", "Tasso Storni"])
    b = spark.createDataFrame([("y", "Spesa", 3)], ["periodo", "Missione Spesa", "Numero Scontrini"])
    documents = reports.period_documents("t", "d", {"cassieri": a, "missioni": b})
    reports.write_documents(documents, str(tmp_path / "docs"))
    back = {r["periodo"]: r for r in reports.read_documents(spark, str(tmp_path / "docs"), documents).collect()}
    assert set(back) == {"x", "y", None}
    assert [tuple(c) for c in back["x"]["cassieri"]] == [("1", 0.5), ("2", 0.7)] and back["x"]["missioni"] == []
    assert back["y"]["missioni"][0]["Numero Scontrini"] == 3 and len(back[None]["cassieri"]) == 1
    assert set(back["y"]["metadata"]["dizionario_dati"]) == {
        "periodo", "Codice Cassiere", "Tasso Storni", "Missione Spesa", "Numero Scontrini"
    }


def test_parquet_wins_over_csv(spark, tmp_path):
    (tmp_path / "ragged.csv").write_text(RAGGED + "\n")
    spark.createDataFrame([(3, 0.25)], "code int, amount double").write.parquet(
        str(tmp_path / "part")
    )
    df = receipts.read_receipts(spark, str(tmp_path / "part"))
    assert df.columns == ["code", "amount"] and df.count() == 1
    assert receipts.read_receipts(spark, str(tmp_path / "*.csv"), fmt="csv").count() == 4
    with pytest.raises(FileNotFoundError, match="nothing"):
        receipts.read_receipts(spark, str(tmp_path / "nothing"))


def test_hash_sample_is_stable_and_nested(spark):
    ids = spark.range(5000).select(F.col("id").cast("string").alias("receipt_id"))
    tenth = rows_of(receipts.hash_sample(ids, "receipt_id", 0.1), "receipt_id")
    third = rows_of(receipts.hash_sample(ids.repartition(7), "receipt_id", 0.3), "receipt_id")
    assert 400 < len(tenth) < 600 and set(tenth) < set(third)
    assert receipts.hash_sample(ids, "receipt_id", 1.0).count() == 5000


def test_sampling_whole_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(400).repartition(40).write.parquet(path)
    df = spark.read.parquet(path)
    sample = receipts.hash_sample(df, F.col("_metadata.file_path"), 0.5)
    read = {os.path.basename(f) for f in _files(sample)}
    paths = df.select(F.col("_metadata.file_path").alias("p")).distinct()
    want = {os.path.basename(r[0]) for r in receipts.hash_sample(paths, "p", 0.5).collect()}
    assert read == want and 0 < len(read) < 40
    assert receipts.preview(df).count() == 5


def _document(path):
    (name,) = glob.glob(f"{path}/report/*.json")
    with open(name, encoding="utf-8") as f:
        return json.loads(f.readline())


def test_months_end_to_end(spark, layout, tmp_path):
    root, _ = layout
    out = str(tmp_path / "out")
    results = pipeline.run_months(spark, root, out, 2024, 4, month_end=5, area="382")
    document = _document(f"{out}/reports/missions")
    assert [p["periodo"] for p in document["insight_mensili"]] == ["2024-04", "2024-05"]
    records = document["insight_mensili"][0]["risultati"]
    assert sum(r["Numero Scontrini"] for r in records) == results.receipts.where("period = '2024-04'").count()
    assert {"Missione Spesa", "Percentuale Fatturato", "Percentuale Traffico"} <= set(records[0])
    integrity = _document(f"{out}/reports/integrity")
    assert {"anomalie_sweethearting_cassieri", "alert_pesatura_ortofrutta"} < set(integrity)
    behavior = _document(f"{out}/reports/behavior")
    assert "Fatturato Acquisito" in behavior["analisi_perdita_margine"][0]["dettagli"][0]
    severities = {r[0] for r in results.receipts.select("severity").distinct().collect()}
    assert severities == {"critical", "warning", "info"}
    elbow, vif = pipeline.diagnostics(results.receipts.where("period = '2024-04'"))
    assert elbow.count() == 9 and vif.count() >= 1
    assert {r[0] for r in results.behavior.select("iso_outlier_score").distinct().collect()} <= {-1, 1}
    bulk = spark.read.option("header", True).csv(f"{out}/audit/bulk")
    assert bulk.count() == results.bulk.count()


@pytest.mark.parametrize("rows", [10, 60_000])
def test_growing_sections_are_lines_at_every_size(spark, tmp_path, rows):
    df = spark.range(rows).select(F.lit("p").alias("periodo"), F.col("id").alias("n"))
    path = str(tmp_path / "r")
    reports.write_report(path, "t", "d", {"short": df.limit(3), "long": df}, as_lines=["long"])
    document = _document(path)
    assert document["long"] == "long/" and len(document["short"][0]["dettagli"]) == 3
    assert spark.read.json(f"{path}/long").count() == rows


def test_years_are_found_at_any_depth(spark, tmp_path):
    row = spark.range(1).select(F.col("id").alias("x"))
    root = f"{tmp_path}/{receipts.LINES_FOLDER}/area=A"
    for n, branch in enumerate(["", "b/", "b/c/d/e/f/", "z/z/z/z/"]):
        row.withColumn("x", F.lit(n)).write.parquet(f"{root}/{branch}year=2024/month=3/day=1")
    row.write.parquet(f"{root}/year=2023/month=3/day=1")
    got = receipts.scan_period(spark, str(tmp_path), 2024, 3)
    assert sorted(r.x for r in got.select("x").collect()) == [0, 1, 2, 3]


def test_mission_report_labels(spark):
    got = QUERIES["report_missions"](spark, SF)
    labels = {r[0] for r in got.select("`Missione Spesa`").collect()}
    assert labels and all("Trip" not in name for name in labels)


def test_scratch_can_be_cleared(spark):
    from tillscope import session

    before = session._staged.pop(spark.sparkContext.applicationId, [])
    staged = session.stage(spark.range(3), "kept")
    (folder,) = session._staged[spark.sparkContext.applicationId]
    assert staged.count() == 3 and os.path.isdir(folder.removeprefix("file://"))
    assert session.clear_scratch(spark) == 1 and not os.path.exists(folder.removeprefix("file://"))
    session._staged[spark.sparkContext.applicationId] = before
