"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run to completion with the ``noop`` sink (every row and column
computed, nothing collected to the driver). Times are warm: every query runs
once untimed on the same data (JIT, class loading), then three times; the
median counts. Model-job queries write to a fresh answer store each run, so
every run pays for all of its answers again.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairwright.plans.queries import QUERIES  # noqa: E402
from pairwright.session import build_session  # noqa: E402

RUNS = 3
HEADLINE = [
    "clean_pairs",
    "lowercase_diff",
    "candidate_flags",
    "candidate_counts",
    "adverb_counts",
    "sample_n",
    "row_index",
    "prompt_single",
    "annotate_single",
    "correct_pairs",
    "before_after_counts",
    "free_variables",
    "cand_missing_parentheses",
    "negation_scopes",
    "word_list_matches",
    "sample_per_category",
    "candidate_counts_delta",
    "strip_special_chars_documents",
    "punctuated_tokens_documents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", app="pairwright-bench", shuffle_partitions=cpus * 2,
                          conf={"spark.driver.memory": "16g"})
    # Warm-up pass on the same data (not measured); each query is then timed RUNS times.
    for key in HEADLINE:
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        runs = []
        for _ in range(RUNS):
            t0 = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[key] = round(median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_sec_warm_median",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
