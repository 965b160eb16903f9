"""The whole period run: from raw lines to audits and reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope import schema
from tillscope.operators import audits, baskets, lines, missions, outliers, selection
from tillscope.plans import reports
from tillscope.session import stage
from tillscope.sources.receipts import scan_period


@dataclass(frozen=True)
class PeriodResults:
    """Everything one run computes; all relations carry ``period``."""

    receipts: DataFrame
    validation: DataFrame
    time_quality: DataFrame
    insights: DataFrame
    bulk: DataFrame
    produce: DataFrame
    alerts: DataFrame
    behavior: DataFrame
    risks: DataFrame
    leakage: DataFrame


def consensus(receipts: DataFrame) -> dict[str | None, list[str]]:
    """Names of the features both models of a period agree on, best first, for each period that has any."""
    found = selection.consensus_features(selection.rf_importance(receipts), selection.lasso_importance(receipts))
    names: dict[str | None, list[str]] = {}
    for row in found.collect():
        names.setdefault(row["period"], []).append(row["feature"])
    return names


def diagnostics(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elbow curve, and VIF of the consensus features (all features without any), for each period."""
    chosen = consensus(receipts)
    alike: dict[tuple[str, ...], list[str | None]] = {}
    for period in missions.periods_of(receipts):
        alike.setdefault(tuple(chosen.get(period, schema.MISSION_FEATURES)), []).append(period)
    parts = []
    for features, periods in alike.items():
        own = reduce(lambda a, b: a | b, [F.col("period").eqNullSafe(F.lit(p)) for p in periods])
        parts.append(selection.vif(receipts.where(own), features))
    factors = reduce(DataFrame.unionByName, parts) if parts else selection.vif(receipts)
    return missions.elbow_curve(receipts), factors


def score_anomalies(receipts: DataFrame) -> DataFrame:
    """Forest score and severity on the consensus features, per period.

    A period without consensus features gets a null score and severity.
    """
    scored = outliers.anomaly_score(receipts, consensus(receipts))
    return audits.severity(stage(scored, "scored-receipts"))


def run(
    raw: DataFrame, centroid_space: str = "scaled", with_anomalies: bool = True
) -> PeriodResults:
    """All relations for raw lines that carry ``period``.

    Receipts are written once, in one folder per period, and shared by the
    receipt-level operators: the models of a period read only its folder. The
    line-level audits each scan just their own columns of the lines.
    """
    normal = lines.normalize_lines(raw)
    features = baskets.basket_features(lines.line_price_features(normal))
    features = stage(features, "baskets", by="period")
    receipts = missions.segment_missions(features, centroid_space=centroid_space)
    receipts = stage(receipts, "missions", by="period")
    tagged = audits.tag_cashier_sweethearting(receipts)
    if with_anomalies:
        tagged = score_anomalies(stage(tagged, "tagged-receipts", by="period"))
    fingerprints = stage(audits.cashier_fingerprint(normal), "fingerprints")
    behavior = audits.behavioral_risk(outliers.behavioral_outliers(fingerprints))
    return PeriodResults(
        receipts=tagged,
        validation=baskets.validate_metrics(features),
        time_quality=lines.time_quality(normal),
        insights=missions.mission_insights(receipts),
        bulk=missions.bulk_audit(receipts),
        produce=stage(audits.produce_weighing_errors(normal), "produce-errors"),
        alerts=audits.cashier_alerts(receipts),
        behavior=behavior,
        risks=audits.risk_report(behavior),
        leakage=stage(audits.margin_leakage(normal), "leakage"),
    )


def write(results: PeriodResults, out: str) -> None:
    """The bulk audit as CSV and the three reports as JSON below ``out``."""
    reports.write_bulk_audit(results.bulk, f"{out}/audit/bulk")
    reports.write_report(
        f"{out}/reports/missions",
        "Missioni di spesa",
        reports.DICTIONARY["missions"],
        {"insight_mensili": reports.mission_report(results.insights)},
        records="risultati",
    )
    reports.write_report(
        f"{out}/reports/integrity",
        "Integrità di cassa e pesate",
        reports.DICTIONARY["integrity"],
        {
            "anomalie_sweethearting_cassieri": reports.integrity_report(results.alerts),
            "alert_pesatura_ortofrutta": reports.integrity_report(results.produce),
        },
        as_lines=["alert_pesatura_ortofrutta"],
    )
    reports.write_report(
        f"{out}/reports/behavior",
        "Comportamento dei cassieri e margine",
        reports.DICTIONARY["behavior"],
        {
            "fingerprint_comportamentale_cassieri": reports.behavior_report(results.risks),
            "analisi_perdita_margine": reports.behavior_report(results.leakage),
        },
    )


def run_months(
    spark: SparkSession,
    data_path: str,
    out: str,
    year: int,
    month: int,
    month_end: int | None = None,
    day: int | None = None,
    day_end: int | None = None,
    area: str | None = None,
) -> PeriodResults:
    """Scan, compute and write a range of months; statistics stay within a month."""
    raw = scan_period(spark, data_path, year, month, month_end, day, day_end, area)
    results = run(raw)
    write(results, out)
    return results
