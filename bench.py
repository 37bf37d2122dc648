"""Time the headline queries once each and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

from gapwise.plans.catalogue import QUERIES
from gapwise.session import build_session

HEADLINE = [
    "prf_missing_table", "prf_bounds", "spl_train_test", "cor_make_dirty", "imp_mean_mode",
    "imp_knn", "scl_standard", "ols_fit", "svm_fit_newton", "cm_linear", "cm_linear_neg",
    "cm_linear_rowwise", "cm_score", "cm_svm_score", "cm_poly_check", "acm_linear",
    "acm_worst_case_gd", "ac_run", "exp_seed_not_exists",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{folder}/part.parquet").count()  # start executors before timing
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).collect()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
