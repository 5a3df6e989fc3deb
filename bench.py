"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from siterank import catalog
from siterank.session import build_session

HEADLINE = [
    "score_sites", "percentile_metrics", "latest_order_per_customer", "running_sequence_per_customer",
    "nearest_known_site", "events_near_site", "features_within_radius", "sites_in_polygons",
    "registry_key_match", "classify_attributes", "orders_per_status",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    times = {}
    for name in HEADLINE:
        if name not in catalog.QUERIES:
            continue
        t = time.time()
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d)}))


if __name__ == "__main__":
    main()
