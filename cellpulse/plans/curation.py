"""Batch curation from daily CSV files to published tables.

    spark-submit cellpulse/plans/curation.py --input 'landing/*.csv' --output curated \
        [--reference cells.geojson] [--gate] [--input-bytes 100000000000000]
"""

import argparse
import contextlib
import datetime as dt
import os
import re
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cellpulse.operators import checks, clean, geo, rollup
from cellpulse.schemas import RAW_CHANNELS, RENAMES
from cellpulse.session import build_session, remove, scratch_table, size_shuffles
from cellpulse.sources import files, gate, geojson


DAY_IN_NAME = r"(\d{4}-\d{2}-\d{2})[^/]*$"
#: Stands for the day of rejected rows that have none, neither in themselves nor in the file's name.
NO_DAY = dt.date(1970, 1, 1)


@contextlib.contextmanager
def admit(spark: SparkSession, pattern: str, output: str, now):
    """Gate the files and store the verdicts; the rows of the accepted files, and their names' days.

    The text is read once: header and rows go to a folder per file, and what follows reads columns of
    those. Verdicts are read back from storage, so Spark knows how small they are, and only the folders of
    the files asked for are opened. The stored lines go when the block ends.
    """
    ledger = f"{output}/ingestion_ledger"
    moment = F.lit(now).cast("timestamp")
    with contextlib.ExitStack() as done:
        lines = files.staged_lines(spark, pattern)
        staged = done.enter_context(scratch_table(lines, "lines", by=["_file"]))
        verdicts = done.enter_context(scratch_table(gate.staged_gate(staged), "verdicts"))
        gate.append_ledger(verdicts, now, ledger)
        accepted, refused = gate.staged_route(staged, verdicts)
        # One folder per run: what earlier runs refused stays.
        files.write_partitioned(
            refused.withColumn("processed_at", F.date_format(moment, "yyyy-MM-dd-HH-mm-ss")),
            f"{output}/rejected_files",
            by="processed_at",
            rebalance=False,
        )
        days = verdicts.filter(F.col("status") == "ACCEPTED").select(F.regexp_extract("filename", DAY_IN_NAME, 1))
        yield accepted, [r[0] for r in days.distinct().collect()]


def _delivery_day():
    """The day in a file's name, for rows whose own time may be unreadable."""
    named = F.to_date(F.regexp_extract("_source_file", DAY_IN_NAME, 1))
    return F.coalesce(F.when(F.regexp_extract("_source_file", DAY_IN_NAME, 1) != "", named), "date", F.lit(NO_DAY))


def _days_named(names) -> list[str]:
    return [found[1] for name in names if (found := re.search(DAY_IN_NAME, name))]


def store_activity(raw: DataFrame, output: str, delivered: list[str] | None = None) -> tuple[list, dict]:
    """Clean rows by day and rejected rows by delivery day, from one scan; the clean days and null counts.

    A later run replaces the days that it brings, in both. Days whose rejected rows are gone lose their
    folder; ``delivered`` are the days that the files' names say.
    """
    spark = raw.sparkSession
    observed = Observation("null_profile")
    nulls = [F.count("*").alias("n")]
    nulls += [F.count_if(F.col(RENAMES[c]).isNull()).alias(c) for c in RAW_CHANNELS]
    judged = clean.with_verdict(raw, (observed, nulls))
    judged = judged.withColumn(
        "date", F.when(F.col("verdict") == "clean", F.col("date")).otherwise(_delivery_day())
    )
    keys = files.write_checked(
        judged.drop("_source_file"), f"{output}/activity", by=["verdict", "date"], rebalance=False
    )
    kept = {day.isoformat() for verdict, day in keys if verdict == "rejected"}
    for day in _days_named(raw.inputFiles()) if delivered is None else delivered:
        if day and day not in kept:
            remove(spark, f"{output}/activity/verdict=rejected/date={day}")
    return sorted(day for verdict, day in keys if verdict == "clean"), observed.get


def _record(spark, output: str, now, gated: bool, tasks: dict, counts: DataFrame, hourly: DataFrame | None) -> None:
    """The status of a gated run, as JSON below ``status``."""
    if not gated:
        return
    moment = F.lit(now).cast("timestamp")
    # A run done again at the same moment has left its verdicts twice.
    verdicts = spark.read.parquet(f"{output}/ingestion_ledger").filter(F.col("processed_at") == moment).distinct()
    if hourly is None:
        hourly = spark.createDataFrame([], "timestamp timestamp")
    blanks = sum(counts.select(*RAW_CHANNELS).first())
    record = gate.status_record(verdicts, hourly, now, f"curation-{now:%Y-%m-%dT%H:%M:%S}", tasks, blanks)
    gate.write_status(record, f"{output}/status")


def curate(
    spark: SparkSession, pattern: str, output: str, reference=None, gated: bool = False, now=None
) -> dict:
    """Run all stages; returns the folder of each output and whether the checks let them be published.

    A failing check leaves the published tables as they were. Every stage reads what the one before has stored, so a lost executor costs one stage at most
    and nothing is computed twice.
    """
    paths = {
        name: f"{output}/{name}"
        for name in (
            "null_profile",
            "hourly_grid_summary",
            "daily_traffic_summary",
            "peak_activity_per_grid",
            "hotspots",
            "dashboard",
            "checks",
        )
    }
    paths["clean_activity"] = f"{output}/activity/verdict=clean"
    paths["rejected_rows"] = f"{output}/activity/verdict=rejected"
    # One scan gives the null profile, the clean rows and the rejected rows. Daily files arrive in date
    # order already, so nothing is shuffled to write day folders.
    if gated:
        now = now or spark.sql("SELECT current_timestamp()").first()[0]
        with admit(spark, pattern, output, now) as (raw, delivered):
            days, nulls = store_activity(raw, output, delivered)
    else:
        days, nulls = store_activity(files.read_raw(spark, pattern, text=True), output)
    counts = spark.createDataFrame([nulls])
    files.write_parquet(clean.null_report(counts, RAW_CHANNELS), paths["null_profile"])
    if not days:
        _record(spark, output, now, gated, {"spark_process": "SUCCESS", "publish": "SKIPPED"}, counts, None)
        return paths | {"published": False}

    # Only the days of this batch are rolled up and checked, aside from what is published.
    cleaned = spark.read.parquet(paths["clean_activity"]).filter(F.col("date").isin(days))
    with scratch_table(rollup.hourly_summary(cleaned), "hourly") as batch:
        found = checks.hourly_checks(batch)
        files.write_parquet(found, paths["checks"])
        published = checks.publish(
            batch,
            spark.read.parquet(paths["checks"]),
            lambda rows: files.write_checked(rows, paths["hourly_grid_summary"]),
        )
        if not published:
            _record(spark, output, now, gated, {"spark_process": "SUCCESS", "publish": "FAILED"}, counts, None)
            return paths | {"published": False}
        files.write_partitioned(rollup.daily_summary(batch), paths["daily_traffic_summary"])
    hourly = spark.read.parquet(paths["hourly_grid_summary"])
    files.write_parquet(rollup.peak_per_grid(hourly), paths["peak_activity_per_grid"])
    files.write_dashboard_csv(rollup.dashboard_hourly(hourly), paths["dashboard"])
    top = rollup.hotspots(hourly)
    if reference:
        paths["cell_lookup"] = f"{output}/cell_lookup"
        lookup = geojson.cell_lookup(geojson.read_geojson(spark, reference))
        files.write_parquet(lookup, paths["cell_lookup"])
        stored = spark.read.parquet(paths["cell_lookup"])
        paths["coverage"] = f"{output}/coverage"
        files.write_parquet(geo.geo_coverage(hourly, stored), paths["coverage"])
        top = geo.hotspots_geo(top, stored)
    files.write_parquet(top, paths["hotspots"])
    _record(spark, output, now, gated, {"spark_process": "SUCCESS", "publish": "SUCCESS"}, counts, hourly)
    return paths | {"published": True}


def main():
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--input", required=True, help="pattern of the daily CSV files")
    parser.add_argument("--output", required=True, help="folder for the tables")
    parser.add_argument("--reference", help="GeoJSON file with the cell polygons")
    parser.add_argument("--gate", action="store_true", help="reject files that fail the checks")
    parser.add_argument("--input-bytes", type=int, default=0, help="to size the shuffles")
    args = parser.parse_args()
    spark = build_session("curation")
    size_shuffles(spark, args.input_bytes)
    curate(spark, args.input, args.output, args.reference, gated=args.gate)


if __name__ == "__main__":
    main()
