"""From raw rows to clean activity: rename, cast, reject, fill, derive."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellpulse.functions.columns import (
    percent,
    weekday_monday_zero,
    weekday_sunday_one,
    weekday_sunday_zero,
)
from cellpulse.schemas import CHANNELS, RENAMES


def canonicalise(raw: DataFrame) -> DataFrame:
    """Canonical names and types. Values that do not parse become null, not errors."""
    kinds = dict(raw.dtypes)

    def typed(source):
        target, column = RENAMES[source], F.col(source)
        if source == "datetime":
            parsed = F.try_to_timestamp(column) if kinds[source] == "string" else column
            return parsed.cast("timestamp").alias(target)
        kind = T.IntegerType() if source in ("CellID", "countrycode") else T.DoubleType()
        return column.try_cast(kind).alias(target)

    extras = [c for c in raw.columns if c not in RENAMES]
    return raw.select(*[typed(c) for c in RENAMES], *extras)


def is_invalid():
    """Structural nulls or any negative measure reject a row; missing measures do not."""
    bad = F.col("grid_id").isNull() | F.col("timestamp").isNull()
    for c in CHANNELS:
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(False))
    return bad


def flag_invalid(df: DataFrame) -> DataFrame:
    return df.withColumn("is_invalid", is_invalid())


def rejected(raw: DataFrame) -> DataFrame:
    return canonicalise(raw).filter(is_invalid())


def with_totals(df: DataFrame) -> DataFrame:
    sms = F.col("sms_in") + F.col("sms_out")
    calls = F.col("call_in") + F.col("call_out")
    return df.withColumns(
        {
            "total_sms": sms,
            "total_calls": calls,
            "total_activity": sms + calls + F.col("internet_activity"),
        }
    )


def _with_derived(df: DataFrame) -> DataFrame:
    ts = F.col("timestamp")
    return with_totals(df).withColumns(
        {"date": F.to_date(ts), "hour": F.hour(ts), "day_of_week": weekday_sunday_one(ts)}
    )


def filled(column: str):
    """A measure with 0 where there is none, and where it is not a number."""
    return F.coalesce(F.nanvl(F.col(column), F.lit(None).cast("double")), F.lit(0.0))


def clean(raw: DataFrame) -> DataFrame:
    accepted = canonicalise(raw).filter(~is_invalid())
    return _with_derived(accepted.withColumns({c: filled(c) for c in CHANNELS}))


def with_verdict(raw: DataFrame, watch: tuple | None = None) -> DataFrame:
    """Clean and rejected rows in one frame, told apart by ``verdict``.

    For writing both from a single scan of the raw files. Measures of rejected rows stay as they
    came; their totals are null where a measure is. ``watch``, an Observation and its metrics, sees
    the typed rows before anything is filled.
    """
    typed = canonicalise(raw)
    if watch is not None:
        typed = typed.observe(watch[0], *watch[1])
    judged = typed.withColumn("verdict", F.when(is_invalid(), "rejected").otherwise("clean"))
    accepted = F.col("verdict") == "clean"
    measures = {c: F.when(accepted, filled(c)).otherwise(F.col(c)) for c in CHANNELS}
    return _with_derived(judged.withColumns(measures))


def null_counts(columns: list[str]) -> list:
    """Aggregates of a null profile, also usable as metrics observed during a write."""
    return [F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]]


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column in one pass, reported in long form."""
    return null_report(df.agg(*null_counts(columns)), columns)


def null_report(counts: DataFrame, columns: list[str]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(c).alias("null_count"),
            percent(F.col(c), F.col("n")).alias("null_pct"),
        )
        for c in columns
    ]
    return counts.select(F.inline(F.array(*rows)))


def row_balance(raw: DataFrame, cleaned: DataFrame, refused: DataFrame) -> DataFrame:
    """raw = clean + rejected, each side counted on its own plan."""
    n_clean = cleaned.agg(F.count("*")).scalar()
    n_refused = refused.agg(F.count("*")).scalar()
    return (
        raw.agg(F.count("*").alias("raw_rows"))
        .select("raw_rows", n_clean.alias("clean_rows"), n_refused.alias("rejected_rows"))
        .withColumn(
            "balanced", F.col("raw_rows") == F.col("clean_rows") + F.col("rejected_rows")
        )
    )


def time_parts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The calendar parts in use, each weekday encoding under its own name."""
    t = F.col(ts)
    return df.withColumns(
        {
            "date": F.to_date(t),
            "hour": F.hour(t),
            "dow_sunday_1": weekday_sunday_one(t),
            "dow_sunday_0": weekday_sunday_zero(t),
            "dow_monday_0": weekday_monday_zero(t),
            "day_name": F.date_format(t, "EEEE"),
        }
    )
