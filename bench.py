"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from nascent.plans import catalog
from nascent.session import build_session

HEADLINE = [
    "panel_volume",
    "panel_build",
    "panel_summary",
    "panel_integrity",
    "length_histogram",
    "product_canonical",
    "drilldown",
    "stratified_sample",
    "stratified_split",
    "hashed_vectors",
    "tfidf_sum_terms",
    "tfidf_mean_ngrams",
    "npmi",
    "soft_assign",
    "target_distribution",
    "linked_clusters",
    "trajectories",
    "silhouette",
    "davies_bouldin",
    "filter_features",
    "ranked_clusters",
    "case_match",
    "report_table",
    "dashboard_points",
    "live_novelty",
    "stream_daily_volume",
    "autoencoder",
    "dec_windows",
    "emergence_score",
    "mlp_classifier",
    "boosted_fused",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM paths and a Python worker once, outside the timings.
    catalog.QUERIES["panel_volume"](spark, sf_dir).count()
    spark.range(1).mapInPandas(lambda batches: batches, "id long").count()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    result = {
        "metric": "headline queries, total seconds",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
