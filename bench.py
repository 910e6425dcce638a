"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is written to Spark's no-op sink: all rows are computed, none are collected. One timed run after
a warm-up run.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import catalogue
from tidemark.session import local_session

HEADLINE = ["feed_page", "url_canonical", "fingerprint_groups", "observation_state", "coverage_rollup", "feed_duplicate_count", "search_expr_and", "matched_sources", "upsert_last_nonnull", "interval_join_unique", "near_duplicate_edges"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores=os.environ.get("BENCH_CPUS", "8"))
    took: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for again in range(2):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if again:
                best = min(best, time.perf_counter() - start)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
