"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is fully executed (noop sink, no collect); the reported value is
the sum of per-query wall times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.session import build_session  # noqa: E402

HEADLINE = [
    "cu_class_distribution",
    "cu_balanced_dataset",
    "cu_target_check",
    "cu_overlap_check",
    "sc_semantic_score",
    "ev_accuracy_by_type",
    "ev_overall_accuracy",
    "sch_prune_eval",
    "sch_prune_dataset_report",
    "sch_reformat",
    "pr_truncate_mask",
    "pr_pad_batch",
    "pr_chat_render",
    "rt_context_assembly",
    "wl_4plus_table_join",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    from tessera.plans.queries import QUERIES
    names = [n for n in HEADLINE if n in QUERIES]
    if len(sys.argv) > 1:
        names = sys.argv[1:]
    # Warm-up on the smallest tables: compiles each query's generated code and
    # warms the JIT (generated classes are cached by code, not by input path);
    # every query is then timed once on the target tables.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in names:
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_wall",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
