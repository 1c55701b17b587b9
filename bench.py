"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the cores.  Every result is produced in full and
thrown away by Spark's no-op sink, so nothing is cut short and nothing crosses the driver.  Further queries can be
named as arguments.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfmark.plans.catalog import QUERIES  # noqa: E402
from shelfmark.session import local_session  # noqa: E402

HEADLINE = (
    "se3_ranked_search", "se4_collection_titles", "se7_nearest_vectors", "pf3_item_page", "j3_collection_cards", "ag1_visual_status_counts", "ag2_failure_summary",
    "ag5_evaluation", "ag7_profile_terms", "w1_latest_run", "mb5_review_invariant", "mb9_merge_memberships", "sy1_reconcile_full",
    "sy6_outcomes", "en1_label_filter", "en2_facet_evidence", "rs8_decisions", "sm4_rate_limit", "cp1_pair_scores", "cg2_groups",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
