"""The recorded workloads at the recorded size: 15.1 M raw rows in daily CSV files.

Repeats the events of ``$BENCH_SF_DIR`` (default sf0.1) under new cell numbers, writes them as CSV
below the scratch folder (about 0.6 GB) and times the stages. Prints one JSON line. Every stage is
timed once, in a JVM that was not warmed up.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
COPIES = 151
GEO_ROWS = 1_680_000


def main():
    from pyspark.sql import functions as F

    from cellpulse.operators import alerts, anomaly, features, geo, ml
    from cellpulse.plans.curation import curate
    from cellpulse.session import build_session, materialise, scratch_dir
    from cellpulse.sources import files, geojson
    from cellpulse.sources.events import raw_activity

    spark = build_session(
        "bench-reference-size",
        master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=32,
        spark__sql__files__maxPartitionBytes="24m",
        spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - start, 2)
        return result

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    copy = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    raw = raw_activity(spark, SF_DIR).withColumn("copy", copy)
    raw = raw.withColumn("CellID", (F.col("CellID") + F.col("copy") * 40).cast("int")).drop("copy")
    pattern = files.write_daily_csv(raw, scratch_dir(spark, "raw-csv"))

    n_raw = timed("raw_csv_count", lambda: files.read_raw(spark, pattern).count())
    out = scratch_dir(spark, "curated")
    paths = timed("curation", lambda: curate(spark, pattern, out))
    hourly = spark.read.parquet(paths["hourly_grid_summary"])
    n_hourly = timed("hourly_count", hourly.count)

    cells = hourly.select("grid_id").distinct()
    lookup_path = scratch_dir(spark, "lookup")
    geojson.cell_lookup(geojson.square_documents(cells)).write.parquet(lookup_path)
    lookup = spark.read.parquet(lookup_path)
    timed("geo_join", lambda: run(geo.geo_enrich(hourly, lookup)))
    # As many rows as the recorded join had, counted as it was.
    part = materialise(hourly.limit(GEO_ROWS), "part")
    timed("geo_join_counted", lambda: geo.geo_enrich(part, lookup).count())
    timed("alerts", lambda: run(alerts.alerts(hourly)))
    timed("trailing_median", lambda: run(features.trailing_median(hourly)))
    timed("features", lambda: run(features.features(hourly)))
    timed("expanding_baseline", lambda: run(anomaly.anomalies(hourly)))
    last = hourly.agg(F.max("date")).first()[0]
    state = timed("baseline_state", lambda: materialise(anomaly.order_state(hourly.filter(F.col("date") < last)), "state"))
    new = hourly.filter(F.col("date") == last)
    timed("baseline_of_a_new_day", lambda: run(anomaly.anomalies_increment(state, new)))
    train, _ = timed("training_rows", lambda: ml.prepare(features.training_table(hourly)))
    timed("tree_fit", lambda: ml.fit_tree(train))
    print(
        json.dumps(
            {
                "metric": "reference_size_total",
                "value": round(sum(seconds.values()), 2),
                "unit": "sec",
                "raw_rows": n_raw,
                "hourly_rows": n_hourly,
                "training_rows": train.count(),
                "queries": seconds,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
