"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from faultline.plans.registry import QUERIES
from faultline.session import drop_stages, local_session

HEADLINE = (
    "rolling_zscore", "rolling_zscore_sliced", "asof_specs", "asof_specs_merged", "severity", "incidents", "chunks",
    "hash_embed_sparse", "vector_top3", "context", "diagnosed", "crew_ranked", "planned", "recovery", "kpis",
    "fleet_status", "history_240", "activity_feed", "dq_summary", "contract_rejects", "upsert_latest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # One untimed query first, so that no entry pays for starting the JVM and the Python workers.
    QUERIES["chunks"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        drop_stages(spark)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))


if __name__ == "__main__":
    main()
