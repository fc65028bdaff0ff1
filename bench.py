"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query runs once to warm up, then REPEATS times; the median counts."""

import json
import os
import statistics
import time

from runlens.plans import catalog
from runlens.session import local_session

SF_DIR, CPUS, REPEATS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_REPEATS", "3"))
HEADLINE = [
    "line_vote_ranges", "line_iou", "file_agreement", "verdicts", "base_golden_classes", "final_shards", "retry_audit", "blocked_entries", "workflow_bindings",
    "patch_findings", "trace_findings", "control_failures", "stream_outcomes", "snippet_problems", "recall_by_instance", "source_misses", "manifest_compare", "redacted_texts",
]


def main() -> None:
    spark = local_session(cores=CPUS, partitions=int(CPUS), memory="16g")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(REPEATS + 1):
            begin = time.perf_counter()
            catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        took[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
