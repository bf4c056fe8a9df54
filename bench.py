"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, to time others ("slow": the boosted models too)

Each query runs once on the smallest tables first, so that the timed run measures the
data and not the compilation of its code. Training queries train in the timed run; the
tables that all model queries share are prepared, and timed, as ``model_tables``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from faultline.plans.queries import QUERIES
from faultline.session import build_session

HEADLINE = (
    "dashboard_summary", "monitoring_summary", "risk_distribution", "top_actions",
    "to_numeric", "missing_profile", "duplicate_rows", "median_impute",
    "preprocess_dataset", "warehouse_features",
    "balance_classes", "exact_stratified_split", "model_tables", "standardize",
    "roc_auc", "model_metrics", "threshold_sweep",
    "train_logreg_balanced", "tree_shap", "shap_importance_ranked",
    "src_preamble_csv",
)
#: Boosted training is 300 rounds of Spark jobs; named here it is timed as any other query.
SLOW = ("train_boosted_weighted", "tree_shap_additivity", "batch_score_job")


def run(spark, sf_dir: str, name: str) -> float:
    """Plan and run to the last row; the rows go nowhere."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = (*HEADLINE, *SLOW) if wanted == "slow" else wanted.split(",") if wanted else HEADLINE
    spark = build_session(
        "faultline-bench", f"local[{cpus}]", spark__ui__enabled="false",
        # A table of few small files is cut at its row groups, so that all cores read it.
        spark__sql__files__maxPartitionBytes="2m", spark__sql__files__openCostInBytes="64k",
        spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    times = {}
    for name in names:
        if os.path.isdir(small) and os.path.basename(sf_dir.rstrip("/")) != "sf0.001":
            run(spark, small, name)
        times[name] = run(spark, sf_dir, name)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
