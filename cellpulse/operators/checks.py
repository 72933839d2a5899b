"""Checks as frames: a caller decides when to run them and what to do about them."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.functions.columns import count_where, not_finite
from cellpulse.functions.quantiles import exact_quantiles
from cellpulse.schemas import HOURLY_SCHEMA, MAX_CELL, MEASURES, MIN_CELL


def _any(conditions):
    return reduce(lambda a, b: a | b, conditions)


def _long(one_row: DataFrame, names: list[str]) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("check_name"), F.col(n).alias("failures")) for n in names]
    return one_row.select(F.inline(F.array(*rows))).withColumn("passed", F.col("failures") == 0)


def hourly_checks(hourly: DataFrame) -> DataFrame:
    """Is the hourly table fit to publish: one row per check with its number of failures."""
    wanted = HOURLY_SCHEMA.fieldNames()
    absent = len([c for c in wanted if c not in hourly.columns])
    faults = {
        "null_keys": F.count_if(F.col("grid_id").isNull() | F.col("timestamp").isNull()),
        "cells_out_of_range": count_where(~F.col("grid_id").between(MIN_CELL, MAX_CELL)),
        "null_measures": F.count_if(_any([F.col(c).isNull() for c in MEASURES])),
        "negative_measures": count_where(_any([F.col(c) < 0 for c in MEASURES])),
    }
    carried = [*faults, "repeated_grain"]
    # Rows are dealt by cell and day once; grain, day of a cell and day are added up one from the other.
    grain = (
        hourly.repartition("grid_id", "date")
        .groupBy("grid_id", "date", "timestamp")
        .agg(F.count("*").alias("n"), F.sum("total_activity").alias("t"), *[c.alias(k) for k, c in faults.items()])
        .withColumn("repeated_grain", (F.col("n") > 1).cast("long"))
    )
    # A repeated key counts in the day that its rows are in; the hours of a day are bits of a number.
    hour_bit = F.expr("shiftleft(1L, hour(timestamp))")
    cell_days = grain.groupBy("grid_id", "date").agg(
        F.sum("t").alias("t"), F.bit_or(hour_bit).alias("hours"), *[F.sum(c).alias(c) for c in carried]
    )
    days = cell_days.groupBy("date").agg(
        F.bit_or("hours").alias("hours"),
        F.count_if(F.col("t") < 0).alias("negative_daily_totals"),
        *[F.sum(c).alias(c) for c in carried],
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    one = days.agg(
        *[total(c) for c in faults],
        total("repeated_grain"),
        F.count_if(F.bit_count(F.coalesce("hours", F.lit(0))) != 24).alias("days_without_24_hours"),
        total("negative_daily_totals"),
        F.lit(absent).cast("long").alias("missing_columns"),
        F.lit(int("geometry" in hourly.columns)).cast("long").alias("geometry_in_hourly"),
    )
    return _long(one, one.columns)


def publish_gate(checks: DataFrame) -> DataFrame:
    """One row: publish only if every check passed."""
    return checks.agg(
        F.count("*").alias("checks_run"),
        F.count_if(~F.col("passed")).alias("checks_failed"),
        F.array_join(
            F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check_name")))), ", "
        ).alias("failed_checks"),
    ).withColumn(
        "decision", F.when(F.col("checks_failed") == 0, "PUBLISH").otherwise("DO NOT PUBLISH")
    )


def publish(df: DataFrame, checks: DataFrame, write) -> bool:
    """Run the gate and call ``write(df)`` only when it is open."""
    opened = publish_gate(checks).first()["decision"] == "PUBLISH"
    if opened:
        write(df)
    return opened


def feature_checks(features: DataFrame) -> DataFrame:
    """Nulls, non-finite values, out-of-range ids, hours and shares, repeated keys."""
    doubles = [n for n, kind in features.dtypes if kind == "double"]
    grain = features.groupBy("grid_id", "feature_timestamp").count()
    one = features.agg(
        F.count_if(_any([F.col(c).isNull() for c in features.columns])).alias("null_rows"),
        count_where(_any([not_finite(F.col(c)) for c in doubles])).alias("non_finite_rows"),
        count_where(~F.col("grid_id").between(MIN_CELL, MAX_CELL)).alias("cells_out_of_range"),
        count_where(~F.col("active_hours").between(0, 24)).alias("active_hours_out_of_range"),
        count_where(~F.col("internet_share").between(0, 1)).alias("share_out_of_range"),
    ).withColumn("repeated_keys", grain.agg(F.count_if(F.col("count") > 1)).scalar())
    return _long(one, one.columns)


def audit_sample(df: DataFrame, k: int, ts: str = "timestamp") -> DataFrame:
    """A sample that can be drawn again: every k-th value of a key built from cell and hour."""
    return df.filter(F.pmod(F.col("grid_id") * 31 + F.hour(ts) + F.dayofyear(ts) * 7, F.lit(k)) == 0)


def describe(df: DataFrame, columns: list[str], extra: list[float] = ()) -> DataFrame:
    """count, mean, std, min, max and exact quartiles per column, in long form."""
    one = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(F.col(c).cast("double")).alias("min_value"),
                F.max(F.col(c).cast("double")).alias("max_value"),
            ).alias(c)
            for c in columns
        ]
    )
    basics = one.select(F.inline(F.array(*columns)))
    qs = sorted({0.25, 0.5, 0.75, *extra})
    spread = exact_quantiles(df, columns, qs).groupBy("column").agg(
        *[
            F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"p{q * 100:g}".replace(".", "_"))
            for q in qs
        ]
    )
    return basics.join(spread, "column")
