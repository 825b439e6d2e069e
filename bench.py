"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from liasse.plans import QUERIES
from liasse.session import local_session

HEADLINE = (
    "identifier_mentions", "legibility_score", "body_text", "sentences", "piece_segmentation", "piece_type_rules", "shared_identifiers",
    "near_identifiers", "custody_timeline", "findings_custody", "act_chronology", "divergences", "verify_citations", "relevance_scores",
    "case_elements", "control_report", "run_costs", "call_counters",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
