"""Headline queries over ``$BENCH_SF_DIR``; prints one JSON line with seconds per query.

Each query runs twice and the second run counts: the first one pays for starting the JVM's
compiler. Nothing is cached between the runs; both read the Parquet files and compute everything.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
HEADLINE = [
    "null_profile",
    "clean",
    "hourly_summary",
    "daily_summary",
    "dashboard_hourly",
    "hotspots",
    "kpis",
    "ingest_gate",
    "geo_enrich",
    "fact_build",
    "sink_roundtrip",
    "features",
    "trailing_median",
    "training_table",
    "alerts",
    "anomalies",
    "detector_compare",
    "features_as_of",
    "ml_dt",
]


def main():
    from cellpulse.plans.queries import REGISTRY
    from cellpulse.session import build_session

    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for _ in range(2):
        for name in names:
            start = time.perf_counter()
            REGISTRY[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 4)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
