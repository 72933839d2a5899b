"""The daily-file gate: accept or reject whole files, route their rows, keep a ledger."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.functions.columns import count_where, hours_between
from cellpulse.schemas import RAW_CHANNELS, RAW_COLUMNS

HOURS_PER_FILE = 24


def _first_reason(prefix, counts):
    """The first column, in file order, with a positive count, as a reason text or null."""
    return F.coalesce(
        *[
            F.when(
                F.col(counts + c) > 0,
                F.concat(F.lit(f"{prefix} {c}: "), F.col(counts + c).cast("string")),
            )
            for c in RAW_CHANNELS
        ]
    )


def _statistics(row=None) -> list:
    """Aggregates over a file's rows; ``row`` says which of its lines are rows."""
    row = F.lit(True) if row is None else row
    time = F.try_to_timestamp("datetime")
    counts = []
    for c in RAW_CHANNELS:
        number = F.col(c).try_cast("double")
        counts.append(F.count_if(row & number.isNull()).alias(f"odd_{c}"))
        counts.append(count_where(row & (number < 0)).alias(f"neg_{c}"))
    return [
        F.count_if(row).alias("row_count"),
        F.count_if(row & time.isNull()).alias("bad_times"),
        F.countDistinct(F.when(row, time)).alias("hours"),
        *counts,
    ]


def _against_header(header) -> dict:
    """Missing columns, and whether the others stand in order."""
    required = F.array(*[F.lit(c) for c in RAW_COLUMNS])
    return {
        "absent": F.array_join(F.array_except(required, header), ", "),
        "ordered": F.slice(header, 1, len(RAW_COLUMNS)) == required,
    }


def ingest_gate(raw_text: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """One verdict per file from one aggregation over its rows.

    ``headers`` (filename, header) adds the check for missing columns and lets files without any
    row appear. The scan takes columns by place, so a file with another order is refused rather
    than misread. Blank measures are legal nulls: the file is accepted and the reason says so.
    Negative values in any measure reject it.
    """
    stats = raw_text.groupBy(F.col("_source_file").alias("filename")).agg(*_statistics())
    if headers is None:
        stats = stats.withColumns({"absent": F.lit(""), "ordered": F.lit(True)})
    else:
        stats = headers.select(
            "filename", *(c.alias(name) for name, c in _against_header(F.col("header")).items())
        ).join(stats, "filename", "full")

    return stats.select("filename", *_verdict())


def staged_gate(staged: DataFrame) -> DataFrame:
    """``ingest_gate`` of ``files.staged_lines`` as stored, with the file's key and its header's place.

    Header lines after the first are rows, with a time that cannot be read.
    """
    rows = F.col("_header").isNull()
    none = F.array().cast("array<string>")
    stats = staged.groupBy("_file", F.col("_source_file").alias("filename")).agg(
        *_statistics(rows),
        F.coalesce(F.min_by("_header", "_at"), none).alias("header"),
        F.min("_at").alias("header_at"),
        F.greatest(F.count("_at") - 1, F.lit(0)).alias("_more"),
    )
    more = {c: F.col(c) + F.col("_more") for c in ("row_count", "bad_times", *(f"odd_{c}" for c in RAW_CHANNELS))}
    stats = stats.withColumns(more | _against_header(F.col("header")))
    return stats.select("filename", *_verdict(), "_file", "header_at")


def staged_route(staged: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows) of stored lines; only the folders of the files asked for are read."""

    def of(status):
        files = verdicts.filter(F.col("status") == status)
        return files.select("_file", F.col("filename").alias("_source_file"), "header_at")

    def routed(status):
        met = staged.join(of(status), ["_file", "_source_file"])
        return met.filter(F.col("_header").isNull() | (F.col("_at") > F.col("header_at"))).select(
            *RAW_COLUMNS, "_source_file"
        )

    return routed("ACCEPTED"), routed("REJECTED")


def _verdict() -> list:
    """status, row_count and reason from a file's statistics."""
    n = F.coalesce(F.col("row_count"), F.lit(0))
    # The wording of the verdicts.
    structural = (
        F.when(
            F.col("absent") != "", F.concat(F.lit("Missing required column(s): "), F.col("absent"))
        )
        .when(~F.col("ordered"), "Unexpected order of columns")
        .when(n == 0, "File contains zero rows")
        .when(
            F.col("bad_times") > 0,
            F.concat(F.lit("Malformed timestamp values: "), F.col("bad_times").cast("string")),
        )
        .when(
            F.col("hours") != HOURS_PER_FILE,
            F.concat(
                F.lit("Expected exactly 24 distinct hourly timestamps, found "),
                F.col("hours").cast("string"),
            ),
        )
    )
    refusal = F.coalesce(structural, _first_reason("Negative activity values found in", "neg_"))
    remark = F.coalesce(
        _first_reason("Non-numeric values found in", "odd_"),
        F.lit("Minimum quality validation passed"),
    )
    return [
        F.when(refusal.isNull(), "ACCEPTED").otherwise("REJECTED").alias("status"),
        n.alias("row_count"),
        F.coalesce(refusal, remark).alias("reason"),
    ]


def source_grain_checks(raw_text: DataFrame) -> DataFrame:
    """Per file: does its date equal the dates inside, and how many rows repeat the source grain.

    Grouping by the full grain first spreads even one huge file over all tasks.
    """
    grain = ["_source_file", "datetime", "CellID", "countrycode"]
    day = F.to_date(F.try_to_timestamp("datetime"))
    named = F.to_date(F.regexp_extract("_source_file", r"(\d{4}-\d{2}-\d{2})[^/]*$", 1))
    return (
        raw_text.groupBy(*grain)
        .count()
        .groupBy(F.col("_source_file").alias("filename"))
        .agg(
            F.sum(F.when(F.coalesce(day != named, F.lit(False)), F.col("count")).otherwise(0)).alias(
                "rows_of_other_dates"
            ),
            F.sum(F.col("count") - 1).alias("repeated_rows"),
        )
    )


def ingest_route(raw: DataFrame, gate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows); the source files stay where they are."""
    passed = gate.filter(F.col("status") == "ACCEPTED").select(
        F.col("filename").alias("_source_file")
    )
    return (
        raw.join(passed, "_source_file", "left_semi"),
        raw.join(passed, "_source_file", "left_anti"),
    )


def ingest_ledger(gate: DataFrame, now) -> DataFrame:
    return gate.select(
        "filename",
        "status",
        "row_count",
        "reason",
        F.lit(now).cast("timestamp").alias("processed_at"),
    )


def append_ledger(gate: DataFrame, now, path: str) -> None:
    ingest_ledger(gate, now).write.mode("append").parquet(path)


def status_record(
    gate: DataFrame, hourly: DataFrame, now, run_id: str, tasks: dict[str, str], nulls_handled: int | None = None
) -> DataFrame:
    """``run_status`` as the record that is stored for one run, with the states of its tasks.

    Columns: run_id, timestamp, status, tasks (map), rows_in, rows_rejected, nulls_handled, rows_published,
    current_as_of, freshness (latest_data_timestamp, age_hours, indicator), healthy, reasons.
    """
    states = [F.lit(text) for pair in sorted(tasks.items()) for text in pair]
    as_map = F.create_map(*states) if states else F.create_map().cast("map<string,string>")
    return run_status(gate, hourly, now, tasks).select(
        F.lit(run_id).alias("run_id"),
        F.lit(now).cast("timestamp").alias("timestamp"),
        "status",
        as_map.alias("tasks"),
        "rows_in",
        "rows_rejected",
        F.lit(nulls_handled).cast("long").alias("nulls_handled"),
        "rows_published",
        "current_as_of",
        F.struct(
            F.col("current_as_of").alias("latest_data_timestamp"), "age_hours", F.col("freshness").alias("indicator")
        ).alias("freshness"),
        "healthy",
        "reasons",
    )


def write_status(record: DataFrame, path: str) -> None:
    """One JSON file with the newest record; nulls are written."""
    record.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def run_status(gate: DataFrame, hourly: DataFrame, now, tasks: dict | None = None) -> DataFrame:
    """One row on the last run: rows in, rejected, published, freshness, health and reasons."""
    tasks = tasks or {}
    published = hourly.agg(F.count("*").alias("n"), F.max("timestamp").alias("t"))
    facts = published.agg(F.max(F.struct("n", "t"))).scalar()
    clock = F.lit(now).cast("timestamp")
    counted = gate.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_in"),
        F.coalesce(
            F.sum(F.when(F.col("status") == "REJECTED", F.col("row_count"))), F.lit(0)
        ).alias("rows_rejected"),
    ).withColumns(
        {"rows_published": facts["n"], "current_as_of": facts["t"]}
    )
    age = hours_between(clock, F.col("current_as_of"))
    spark_ok = F.lit(tasks.get("spark_process", "SUCCESS") == "SUCCESS")
    load_ok = F.lit(tasks.get("load_warehouse", "SUCCESS") == "SUCCESS")
    # The wording of the reasons.
    reasons = F.array_compact(
        F.array(
            F.when(F.col("rows_published") == 0, "Analytics layer contains zero rows."),
            F.when(~spark_ok, "Spark processing was not successful."),
            F.when(~load_ok, "Warehouse loading was not successful."),
        )
    )
    return counted.withColumns({"age_hours": age, "reasons": reasons}).withColumns(
        {
            "rejection_rate_pct": F.when(
                F.col("rows_in") > 0, 100.0 * F.col("rows_rejected") / F.col("rows_in")
            ).otherwise(0.0),
            "freshness": F.when(age.isNull(), "UNKNOWN")
            .when(age <= 2, "FRESH")
            .when(age <= 24, "RECENT")
            .otherwise("STALE"),
            "healthy": F.size("reasons") == 0,
            "status": F.when(F.size("reasons") == 0, "SUCCESS").otherwise("FAILED"),
        }
    )
