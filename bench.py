"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Each query result is fully computed with the no-op sink (nothing is collected);
"value" is the sum over the headline queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # metrics over the 600k-row scored lineitem table
    "metric_roc_auc", "metric_avg_precision", "best_threshold_f1", "best_threshold_youden", "calibration_curve",
    "confusion_matrix", "metric_log_loss", "roc_curve",
    # multiclass metrics and blending over orders
    "metric_roc_auc_ovr", "metric_f1_macro", "blend",
    # profiling and cleaning
    "load_clean", "profile_nulls", "profile_top_values", "skewness", "correlation_matrix", "high_card_columns",
    "rare_categories", "class_imbalance", "auto_plan",
    # feature transforms and splits
    "freq_encode", "impute_numeric", "standard_scale", "one_hot", "yeo_johnson", "mutual_info_topk",
    "preprocess_full", "stratified_folds", "kfold", "sample_rows",
    # modelling
    "oof_predictions", "permutation_importance", "smote", "fit_gbt", "calibrate", "mutual_info_knn", "train_report",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from autotab.session import build_session
    spark = build_session(f"local[{cpus}]", app="autotab-bench", shuffle_partitions=int(cpus))
    from autotab import catalog
    # warm the JVM and the parquet readers
    for t in ("lineitem", "orders", "documents"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in (only or HEADLINE):
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus),
           "shuffle_partitions": int(cpus)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
