"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from semshift.plans import catalog
from semshift.session import build_session

HEADLINE = ["cq01", "cq03", "cq05", "cq06", "cq07", "cq08", "cq09", "cq12", "flat_events", "trigger_impact", "word_dedup", "word_span", "claims_ledger", "trend_share", "facet_year_overlap", "shacl_report"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    times = {}
    for name in HEADLINE:
        for turn in range(2):  # the first one compiles
            began = time.time()
            found[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, second run each", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
