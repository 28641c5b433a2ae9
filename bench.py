"""Headline queries, one warm-up and the median of three runs each; prints one JSON line."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from panelwright.plans import catalog  # noqa: E402
from panelwright.session import local_session  # noqa: E402

HEADLINE = (
    "latest_version", "revision_counts", "release_overlaps", "release_quality", "elapsed_distribution",
    "worksite_link_same_year", "global_case_links", "company_quarter_counts", "quarterly_change",
    "quarter_overview", "transition_rates", "company_features", "labeled_examples", "baseline_scores",
)


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    catalog.REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cores)
    spark.conf.set("spark.sql.shuffle.partitions", str(cores))
    seconds = {}
    for name in HEADLINE:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(repeats)), 3)
    total = round(sum(seconds.values()), 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
