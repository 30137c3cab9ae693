"""Headline bench: seconds per query at one scale factor, one JSON line on stdout.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Each query runs once to warm the JVM and code cache, then once timed into the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from merchgrid.plans import registry  # noqa: E402
from merchgrid.session import local_session  # noqa: E402

HEADLINE = [
    "priority_top", "audit_summary", "weight_sweep", "collection_rank", "rank_with_pins", "listing_rollup", "online_signals_merge", "inventory_rollup",
    "shipping_audit", "health_text", "taxonomy_assign", "update_queue_diff", "shopping_feed", "image_propagation", "variant_order_check", "color_match",
    "gtin_quality", "policy_terms", "url_structure_score", "rescore", "candidate_decisions", "catalog_title_match", "page_extract", "output_quality",
    "fact_quality", "near_dup_pairs", "ngram_overlap", "failure_clusters", "replay_diff", "variant_image_rows", "rolling_signals",
]


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    registry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "merchgrid-bench")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in names:
        run(spark, name, sf)
        took[name] = round(run(spark, name, sf), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
