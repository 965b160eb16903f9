"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillscope.plans.registry import QUERIES  # noqa: E402
from tillscope.session import local_session  # noqa: E402

HEADLINE = (
    "normalize_lines",
    "line_calendar",
    "hash_sample",
    "standard_price",
    "line_price_features",
    "canonical_features",
    "validate_metrics",
    "mission_insights",
    "mission_segmentation",
    "b2b_audit",
    "severity",
    "rf_importance",
    "lasso_importance",
    "vif",
    "anomaly_score",
    "cashier_sweethearting",
    "produce_weighing_errors",
    "cashier_fingerprint",
    "behavioral_risk",
    "margin_leakage",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # an untimed round over the smallest tables starts the workers and warms the code
    smallest = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(smallest):
        for name in names:
            run(spark, name, smallest)
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in names}
    scale = os.path.basename(sf_dir).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
