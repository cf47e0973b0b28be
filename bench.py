"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from overstats import catalog
from overstats.session import session

HEADLINE = (
    "delivery_flags", "flatten_documents", "running_state", "scoreboard", "timeline",
    "partnerships", "batting_innings", "bowling_innings", "batting_by_phase", "batting_splits",
    "bowling_splits", "careers", "yearly", "match_results", "team_records", "team_phases",
    "venue_stats", "batting_claims", "bowling_claims", "batting_profiles", "match_traces",
    "resource_curves", "win_curve", "resolved_metadata", "change_set", "players_by_runs",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="overstats-bench-")
    spark = session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g",
            "spark.checkpoint.dir": scratch,
        })
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": total, "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "deliveries": rows,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
