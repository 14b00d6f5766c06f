"""A fast slice of the driver's correctness gate: Spark queries vs their DuckDB SQL at sf0.001."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from paths import SF001  # noqa: E402

FAST = ["metric_roc_auc", "metric_avg_precision", "best_threshold_f1", "best_threshold_youden", "confusion_matrix",
        "calibration_curve", "metric_f1_macro", "metric_roc_auc_ovr", "blend", "profile_nulls", "skewness",
        "high_card_columns", "freq_encode", "impute_numeric", "one_hot", "stratified_folds", "kfold", "sample_rows",
        "positive_label", "encode_target"]


def test_fast_queries_match_duckdb(spark):
    from oracle_check import check
    res = check(spark, SF001, FAST, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "OK"}
    assert not bad, bad
