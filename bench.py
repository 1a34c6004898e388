"""Wall time of the headline queries; prints one JSON line.

Every query is run once cold in one session (the first one also pays JVM
warm-up) and its whole result is counted through a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trialsift.plans.catalog import load  # noqa: E402
from trialsift.session import local_session  # noqa: E402

HEADLINE = (
    "judgment_counts",
    "domain_judgments",
    "d1_shared_across_outcomes",
    "human_review_basis",
    "agreement_by_group",
    "bootstrap_ci",
    "cluster_bootstrap",
    "resume_missing_pairs",
    "entry_fast_skip",
    "upsert_latest_wins",
    "call_cost",
    "span_pairs",
    "event_sessions",
    "tokens",
    "section_bounds",
    "segment_guards",
    "bm25_topk",
    "rrf_topk",
    "domain_contexts",
    "quote_exact",
    "stream_event_counts",
    "supplement_blocks",
    "assessment_records",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.time()
        registry[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
