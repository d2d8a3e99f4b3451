"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query runs once unmeasured on the
smallest tables first, so that JVM start and code generation are not charged to it; results are written out in full.
"""

from __future__ import annotations

import json
import os
import time

from postsieve.session import local_session
from registry import all_queries

HEADLINE = [
    "d1_exact_dedupe", "d1_dedupe_documents", "p2_hazard_counts", "p6_terms", "p7_places", "r1_score", "g7_geoparse",
    "c3_labels", "c7_geoparse_gate", "a1_themes", "a2_document_terms", "a8_community_briefs", "a9_funnel", "a18_exact_counts", "g15_stacks",
    "g20_stack_listing", "x1_geojson_features", "x3_csv_lines", "s1_read_csv", "s14_page_text", "k3_misses", "c13_failure_breaker",
    "st1_stream_triage", "st5_stream_dedupe",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    queries, seconds = all_queries(), {}
    for name in HEADLINE:
        if os.path.isdir(warm_dir):
            queries[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
