"""Time the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from firnline import survey_session  # noqa: E402
from firnline.plans.bindings import QUERIES  # noqa: E402

HEADLINE = [
    "plot_summary", "plot_summary_gaps", "plot_summary_by_flight", "average_repeats",
    "multipart_distinct", "multipart_first", "station_cores", "sensor_depth", "centroids",
    "daily_totals", "period_totals", "grand_total", "key_count", "rows_per_key", "ordinal",
    "ordinal_by_key", "slice_range", "slice_tail", "bind_cols", "fill_down", "sorted",
    "complete_template", "to_long", "coord_join", "null_key_join", "corrections", "aliases",
    "swe_density_a", "parse_time", "filters", "projection", "union_all", "distinct_meta",
    "utm_forward", "utm_inverse", "run_trip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = survey_session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    timings = {}
    for name in wanted:
        runs = []
        for _ in range(2):  # the first run pays for code generation and file listing
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        timings[name] = round(min(runs), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(sf.group(1)) if sf else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
