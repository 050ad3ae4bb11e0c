"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the number
of local cores.  Each query runs once to warm up and then ``BENCH_RUNS`` times;
the median is reported.  Results are written to Spark's no-op sink, so every row
is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks  # noqa: E402
from pulseframe.session import build_session  # noqa: E402

# Headline queries; the first five are the agreed ones.
HEADLINE = [
    "qry_01_point_history",
    "qry_02_params_history",
    "rsh_03_wide_by_params",
    "agg_02_storage_stats",
    "jon_01_fan_out",
    "agg_04_segment_catalog",
    "agg_12_value_summary_by_param",
    "jon_05_overlap_join",
    "pck_01_device_messages",
    "qry_05_paged_history",
    "rsh_02_points_to_packets",
    "src_05_flat_payload",
    "win_01_current_values",
    "win_02_recent_packets",
    "win_07_parameter_runs_one_file",
    "win_12_merged_rows",
    "qry_01_stored_point",
    "qry_02_stored_zone",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = checks.load()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
