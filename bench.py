"""Seconds per headline query over $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Every query computes its whole result; the rows go to a
sink that drops them. Each is run once before on the smallest tables, so that
the times are those of a session that is up, without compiling its code.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlens.plans.queries import QUERIES  # noqa: E402
from fleetlens.session import local_session  # noqa: E402

HEADLINE = [
    "j9_metadata",
    "f3_instances_on_hosts",
    "a1_job_stats",
    "a3_host_aliases",
    "j1_node_inventory",
    "m1_create_outcomes",
    "m2_patch_instances",
    "m3_delete_attributes",
    "m4_attribute_insert_state",
    "m10_alias_allocate_state",
    "t1_feed_state",
    "t2_job_outcomes",
    "c_catalog_report",
]


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "fleetlens-bench")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in names:
            run(spark, name, small)
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in names}
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
