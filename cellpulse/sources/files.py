"""CSV and Parquet on shared storage: scans, date-partitioned sinks, read-back checks."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cellpulse.schemas import RAW_COLUMNS, RAW_SCHEMA, RAW_TEXT_SCHEMA

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _source_file():
    """The whole path: files of one name in two folders are two files."""
    return F.col("_metadata.file_path")


def base_name(path):
    return F.element_at(F.split(path, "/"), -1)


def read_raw(spark: SparkSession, pattern: str, text: bool = False) -> DataFrame:
    """Daily CSV files with an explicit schema and the file each row came from.

    ``text`` keeps every column as text for the file gate. A pattern that matches no file is an
    error of the scan itself.
    """
    schema = RAW_TEXT_SCHEMA if text else RAW_SCHEMA
    scan = spark.read.schema(schema).option("header", True).option("timestampFormat", TIME_FORMAT)
    return scan.csv(pattern).withColumn("_source_file", _source_file())


def file_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """The header names each file declares, found among its lines, not by opening files here.

    The header is the first line of a file, provided that it holds at least one of the known column
    names; data lines hold numbers and times only. A file without one has an empty list. Lines of
    later blocks are passed over by their block's place.
    """
    names = F.split(F.regexp_replace("value", r'[\s"]', ""), ",")
    known = F.array(*[F.lit(c) for c in RAW_COLUMNS])
    lines = spark.read.text(pattern).select(
        _source_file().alias("filename"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
        F.when(F.col("_metadata.file_block_start") == 0, names).alias("names"),
    )
    first = lines.groupBy("filename").agg(F.min_by("names", F.struct("start", "line")).alias("names"))
    header = F.when(F.arrays_overlap("names", known), F.col("names"))
    return first.select(
        "filename", F.coalesce(header, F.array().cast("array<string>")).alias("header")
    )


def staged_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Header and rows of the files from one scan, to be stored in one folder per file.

    Raw columns as text, ``_source_file``, ``_file`` (a short key of it, for the folder's name), and for
    lines in a file's first block that hold a known column name: ``_header``, the names, and ``_at``, the
    line's place among them. A file's header is the first of these; others are rows like any other.
    """
    names = F.split(F.regexp_replace("value", r'[\s"]', ""), ",")
    known = F.array(*[F.lit(c) for c in RAW_COLUMNS])
    ahead = (F.col("_start") == 0) & F.arrays_overlap("_names", known)
    return (
        spark.read.text(pattern)
        .select("value", _source_file().alias("_source_file"), F.col("_metadata.file_block_start").alias("_start"))
        .filter(F.trim("value") != "")
        .withColumns({"_names": names, "_line": F.monotonically_increasing_id()})
        .withColumn("_row", F.from_csv("value", RAW_TEXT_SCHEMA.simpleString()[7:-1].replace(":", " ")))
        .select(
            "_row.*",
            "_source_file",
            F.when(ahead, F.col("_names")).alias("_header"),
            F.when(ahead, F.col("_line")).alias("_at"),
            F.lower(F.hex(F.xxhash64("_source_file"))).alias("_file"),
        )
    )


def write_partitioned(
    df: DataFrame,
    path: str,
    by=("date",),
    mode: str = "overwrite",
    rebalance: bool = True,
    watch: tuple | None = None,
) -> None:
    """Snappy Parquet in one folder per day.

    The rebalance hint brings a day's rows together and lets the runtime split a day that is too
    big for one task. Rows that still lie as the daily files brought them are together already:
    with ``rebalance=False`` they are written where they are read, without a shuffle. With
    dynamic partition overwrite a re-run replaces only its own days. ``watch`` is an Observation
    and its metrics; they are taken in the writing stage, where every row passes once.
    """
    by = [by] if isinstance(by, str) else list(by)
    rows = df.hint("rebalance", *by) if rebalance else df
    if watch is not None:
        rows = rows.observe(watch[0], *watch[1])
    (
        rows.write.mode(mode)
        .option("compression", "snappy")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """A catalogue table in a folder, dealt and sorted by ``keys``; tables of one number of buckets join
    and group on those keys without an exchange."""
    rows = df.repartition(buckets, *keys)
    (
        rows.write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def write_dashboard_csv(per_hour: DataFrame, path: str) -> None:
    """One CSV file. Only for the per-hour dashboard: its length is the number of hours.

    A repartition, because coalescing would run the aggregation itself in one task.
    """
    per_hour.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_daily_csv(raw: DataFrame, path: str) -> str:
    """Raw rows as one CSV folder per source file; returns the pattern that reads them back."""
    (
        raw.hint("rebalance", "_source_file")
        .write.mode("errorifexists")
        .option("header", True)
        .option("timestampFormat", TIME_FORMAT)
        .partitionBy("_source_file")
        .csv(path)
    )
    return f"{path}/_source_file=*/*.csv"


def schema_matches(expected: DataFrame, actual: DataFrame) -> bool:
    """Same names and types; order and nullability aside, a partition column moves to the end."""
    return sorted(expected.dtypes) == sorted(actual.dtypes)


def readback_checks(df: DataFrame, path: str, by: str = "date") -> DataFrame:
    """What was written against what is on storage, one count per side."""
    stored = df.sparkSession.read.parquet(path)
    n_expected = df.agg(F.count("*")).scalar()
    n_days = df.agg(F.countDistinct(by)).scalar()
    return stored.agg(
        F.count("*").alias("stored_rows"), F.countDistinct(by).alias("stored_partitions")
    ).select(
        n_expected.alias("expected_rows"),
        "stored_rows",
        n_days.alias("expected_partitions"),
        "stored_partitions",
        F.lit(schema_matches(df, stored)).alias("schema_match"),
    ).withColumn(
        "passed",
        (F.col("expected_rows") == F.col("stored_rows"))
        & (F.col("expected_partitions") == F.col("stored_partitions"))
        & F.col("schema_match"),
    )


def write_checked(df: DataFrame, path: str, by=("date",), **options) -> list[tuple]:
    """Write by folder and compare what arrived with what was sent, without computing ``df`` again.

    Rows are counted, and the folders they go to noted, while they are written; stored rows are counted
    in those folders only, the one for missing keys included, because other runs have left theirs
    there. Returns the folders' keys: there are as many as days and verdicts in the batch.
    """
    by = [by] if isinstance(by, str) else list(by)
    sent = Observation()
    # A collected set leaves nulls out, a struct with a null inside stays.
    metrics = [F.count("*").alias("n"), F.collect_set(F.struct(*by)).alias("keys")]
    write_partitioned(df, path, by, watch=(sent, metrics), **options)
    seen = sent.get
    keys = [tuple(k) for k in seen["keys"]]
    if not seen["n"]:
        return keys
    stored = df.sparkSession.read.parquet(path)
    mine = F.lit(False)
    for key in keys:
        same = F.lit(True)
        for name, value in zip(by, key, strict=True):
            same = same & F.col(name).eqNullSafe(F.lit(value))
        mine = mine | same
    found = stored.filter(mine).count()
    if found != seen["n"] or not schema_matches(df, stored):
        raise ValueError(f"{path}: sent {seen['n']} rows as {df.dtypes}, found {found}")
    return keys


def require_readback(df: DataFrame, path: str, by: str = "date") -> None:
    row = readback_checks(df, path, by).first()
    if not row["passed"]:
        raise ValueError(f"read-back of {path} failed: {row.asDict()}")
