"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion with the ``noop`` sink (full computation, nothing
collected to the driver). Session start-up is excluded; every query is first run once on
the sf0.001 tables to warm the JIT and code generation, then timed on $BENCH_SF_DIR.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lectern.session import get_session  # noqa: E402
from lectern.plans.queries import queries  # noqa: E402

HEADLINE = [
    "clean_documents", "sentences", "context_window", "language_id", "normalise_text",
    "holdout_stratified", "kfold_stratified", "growing_subsets", "majority_vote",
    "vocabulary", "token_ids", "score_binary", "eval_metrics", "cv_results",
    "learning_curve_metrics", "multilabel_metrics", "multitask_metrics",
    "fewshot_labels", "review_prevalence", "compare_approaches",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", app_name="lectern-bench",
                        shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = queries()
    # JIT / codegen warm-up on the smallest tables (different data), then timed runs.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        for name in names:
            qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
