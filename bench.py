"""Time the headline queries on one scale folder and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from auditlake.catalog import load
from auditlake.session import local_session

HEADLINE = (
    "plan_scoreboard", "dedupe_best", "cap_by_severity", "assign_confidence", "enrich", "control_status", "consensus", "evaluate",
    "typosquats", "match_advisories", "plan_guard", "rules_core_documents", "rules_core", "project_context", "account_fields",
    "authority_changes", "verification_lag", "near", "token_bucket", "monotone", "reachable", "propagate_labels", "dominators",
    "reaching_definitions", "ctl_ef", "plan_scan", "message_pass", "nearest_patterns", "stream_authority",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "auditlake-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
