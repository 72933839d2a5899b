"""Trailing-window features, medians and next-hour labels.

All windows of one builder share one partitioning and one order, so a history is shuffled and
sorted once. Frames that are bounded in time run over overlapping time blocks (see
``functions.timeblocks``), which keeps every window group small however long the history is.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.columns import (
    add_hours,
    hours_between,
    median_of,
    weekday_monday_zero,
)
from cellpulse.functions.timeblocks import own_rows, with_halo, with_row_halo
from cellpulse.functions.unique import one_row_per
from cellpulse.operators.checks import audit_sample
from cellpulse.schemas import SIX_FEATURES


def _history(df: DataFrame) -> DataFrame:
    measures = ["internet_activity", "total_activity"]
    return (
        df.select("grid_id", "timestamp", *measures)
        .filter(F.col("grid_id").isNotNull() & F.col("timestamp").isNotNull())
        .na.fill(0.0, measures)
    )


def cadence_gaps(df: DataFrame, by: list[str] = ("grid_id",)) -> DataFrame:
    """Each row beside the previous one of its group; a step other than one hour is a gap.

    Without ``by`` all rows are one group: for the distinct hours of a feed, which are as many as its history
    is long.
    """
    previous = F.lag("timestamp").over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("timestamp"))
    step = hours_between(F.col("timestamp"), F.col("previous_timestamp"))
    return (
        df.withColumn("previous_timestamp", previous)
        .withColumn("hour_difference", step)
        .withColumn("cadence_gap", F.coalesce(F.col("hour_difference") != 1, F.lit(False)))
    )


def sequences(df: DataFrame) -> DataFrame:
    """Number the unbroken hourly runs of each cell, from 1."""
    checked = cadence_gaps(df.select("grid_id", "timestamp", "total_activity"))
    starts = (F.col("previous_timestamp").isNull() | F.col("cadence_gap")).cast("int")
    order = Window.partitionBy("grid_id").orderBy("timestamp")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return checked.withColumn("sequence_id", F.sum(starts).over(running)).drop("hour_difference")


def _feature_columns(order, recent: int, variant: str) -> dict:
    near = order.rowsBetween(-(recent - 1), 0)
    activity = F.col("total_activity")
    deviation = F.stddev_samp if variant == "samp" else F.stddev_pop
    return {
        "_avg": F.avg(activity).over(near),
        "_peak": F.max(activity).over(near),
        "_active": F.count_if(activity > 0).over(near),
        "_dev": deviation(activity).over(near),
        "_sum": F.sum(activity).over(near),
        "_net": F.sum("internet_activity").over(near),
    }


def _before_column(order, recent: int, prior: int):
    """Mean of the ``prior`` rows in front of the recent ones. With equal lengths it is the
    recent mean of that many rows ago, which costs no second frame."""
    if recent == prior:
        return F.lag("_avg", recent).over(order)
    far = order.rowsBetween(-(recent + prior - 1), -recent)
    return F.avg("total_activity").over(far)


def _six_features(variant: str) -> list:
    avg, before = F.col("_avg"), F.col("_before")
    at_zero = F.when(avg == 0, 0.0).otherwise(1.0) if variant == "samp" else F.lit(0.0)
    return [
        avg.alias("avg_activity"),
        F.when(before == 0, at_zero).otherwise((avg - before) / before).alias("activity_growth"),
        F.col("_active").cast("int").alias("active_hours"),
        F.when(avg == 0, 0.0).otherwise(F.col("_peak") / avg).alias("peak_ratio"),
        F.coalesce("_dev", F.lit(0.0)).alias("variability"),
        F.when(F.col("_sum") == 0, 0.0).otherwise(F.col("_net") / F.col("_sum")).alias(
            "internet_share"
        ),
    ]


def _unbroken(df: DataFrame, order, hours: int) -> DataFrame:
    """Keep rows that end an unbroken run of ``hours`` hourly rows.

    A running count of the breaks that did not move over the last rows says the same as numbering
    the runs and windowing inside each, without a second partitioning or a long frame.
    """
    step = hours_between(F.col("timestamp"), F.lag("timestamp").over(order))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("_step", step)
        .withColumn("_breaks", F.count_if(F.col("_step") != 1).over(running))
        .withColumn("_breaks_then", F.lag("_breaks", hours - 1).over(order))
        .filter(F.col("_breaks") == F.col("_breaks_then"))
    )


def features(
    history: DataFrame, recent: int = 24, prior: int = 24, variant: str = "samp", **blocks
) -> DataFrame:
    """Six features per (cell, t) from the recent and the prior day.

    ``samp`` needs an unbroken history of both days. ``pop`` takes the last rows whatever the
    gaps between them, uses the population deviation and says 0 growth at a zero baseline; its frames
    reach back a number of rows, so its blocks overlap by rows.
    """
    if variant not in ("samp", "pop"):
        raise ValueError("variant is 'samp' or 'pop'")
    total = recent + prior
    df = _history(history)
    df = with_halo(df, before=total, **blocks) if variant == "samp" else with_row_halo(df, before=total - 1, **blocks)
    order = Window.partitionBy("grid_id", "_block").orderBy("timestamp")
    df = df.withColumns(_feature_columns(order, recent, variant))
    df = df.withColumn("_before", _before_column(order, recent, prior))
    if variant == "samp":
        df = own_rows(_unbroken(df, order, total))
    else:
        df = df.withColumn("_start", F.lag("timestamp", total - 1).over(order))
        df = own_rows(df).filter(F.col("_start").isNotNull())
    return df.select(
        "grid_id", F.col("timestamp").alias("feature_timestamp"), *_six_features(variant)
    )


def _with_median(df: DataFrame, hours: int) -> DataFrame:
    """Exact median of the rows of the last ``hours`` hours and how many they are.

    The frame's values are few (one per hour), so they are listed and sorted; the list does not
    leave this step. An interval frame keeps the order on the timestamp itself, as all other
    windows have it.
    """
    frame = (
        "OVER (PARTITION BY grid_id, _block ORDER BY timestamp "
        f"RANGE BETWEEN INTERVAL {hours - 1} HOURS PRECEDING AND CURRENT ROW)"
    )
    listed = df.withColumn("_recent", F.expr(f"collect_list(total_activity) {frame}"))
    measured = {"_seen": F.size("_recent"), "_median": median_of(F.col("_recent"))}
    return listed.withColumns(measured).drop("_recent")


def trailing_median(history: DataFrame, hours: int = 24, **blocks) -> DataFrame:
    """Exact median of the last ``hours`` hours, only where all of them are present."""
    df = with_halo(history.select("grid_id", "timestamp", "total_activity"), before=hours, **blocks)
    return (
        own_rows(_with_median(df, hours))
        .filter(F.col("_seen") == hours)
        .select(
            "grid_id",
            F.col("timestamp").alias("feature_timestamp"),
            F.col("_median").alias(f"trailing_median_{hours}h"),
        )
    )


def _label_columns(multiplier: float) -> list:
    return [
        F.col("_next_ts").alias("target_timestamp"),
        F.col("_next").alias("target_activity"),
        F.col("_median").alias("trailing_median_24h"),
        F.when(F.col("_median") > 0, F.col("_next") / F.col("_median")).alias("target_ratio"),
        (F.col("_next") > multiplier * F.col("_median")).cast("int").alias("high_activity"),
    ]


def _with_next(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("grid_id", "_block").orderBy("timestamp")
    return df.withColumns(
        {
            "_next": F.lead("total_activity").over(order),
            "_next_ts": F.lead("timestamp").over(order),
        }
    )


def _has_label(hours: int):
    return (
        (F.col("_seen") == hours)
        & (F.col("_next_ts") == add_hours(F.col("timestamp"), 1))
        & F.col("_next").isNotNull()
    )


def next_hour_label(
    history: DataFrame, multiplier: float = 1.5, hours: int = 24, **blocks
) -> DataFrame:
    """1 where the next hour exceeds ``multiplier`` times the trailing median, else 0.

    Rows without a full window or without a row exactly one hour later have no label.
    """
    df = history.select("grid_id", "timestamp", "total_activity")
    df = _with_next(with_halo(df, before=hours, after=1, **blocks))
    df = own_rows(_with_median(df, hours)).filter(_has_label(hours))
    return df.select(
        "grid_id", F.col("timestamp").alias("feature_timestamp"), *_label_columns(multiplier)
    )


def with_calendar(df: DataFrame) -> DataFrame:
    """Hour and weekday (0 = Monday) of t, as the risk model wants them."""
    t = F.col("feature_timestamp")
    return df.withColumns({"hour_of_day": F.hour(t), "day_of_week": weekday_monday_zero(t)})


def ml_dataset(feature_rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and labels of the same (cell, t). A key that occurs twice on either side is an error."""
    key = ["grid_id", "feature_timestamp"]
    return with_calendar(one_row_per(feature_rows, key, "features").join(one_row_per(labels, key, "labels"), key))


def _day_features(df: DataFrame, order) -> DataFrame:
    df = _with_median(df, 24).withColumns(_feature_columns(order, 24, "samp"))
    return df.withColumn("_before", _before_column(order, 24, 24))


def training_table(history: DataFrame, multiplier: float = 1.5, **blocks) -> DataFrame:
    """The rows of ``ml_dataset`` straight from the history: one shuffle and no join."""
    df = _with_next(with_halo(_history(history), before=48, after=1, **blocks))
    order = Window.partitionBy("grid_id", "_block").orderBy("timestamp")
    df = _day_features(df, order)
    df = own_rows(_unbroken(df, order, 48)).filter(_has_label(24))
    return with_calendar(
        df.select(
            "grid_id",
            F.col("timestamp").alias("feature_timestamp"),
            *_six_features("samp"),
            *_label_columns(multiplier),
        )
    )


def feature_table(history: DataFrame, **blocks) -> DataFrame:
    """The six features with trailing median and calendar parts, labelled or not."""
    df = with_halo(_history(history), before=48, **blocks)
    order = Window.partitionBy("grid_id", "_block").orderBy("timestamp")
    df = _day_features(df, order)
    return with_calendar(
        own_rows(_unbroken(df, order, 48)).select(
            "grid_id",
            F.col("timestamp").alias("feature_timestamp"),
            *_six_features("samp"),
            F.col("_median").alias("trailing_median_24h"),
        )
    )


def target_ratio_rows(labels: DataFrame, lo: float = 1.4, hi: float = 1.6) -> DataFrame:
    """Labels close to the threshold."""
    return labels.filter(F.col("target_ratio").between(lo, hi))


def class_balance(labels: DataFrame, label: str = "high_activity") -> DataFrame:
    """Rows and share per class."""
    whole = F.sum("n_rows").over(Window.partitionBy(F.lit(1)))
    return (
        labels.groupBy(label)
        .agg(F.count("*").alias("n_rows"))
        .withColumn("proportion", F.col("n_rows") / whole)
    )


def _compare_features(before: DataFrame, after: DataFrame, tolerance: float) -> DataFrame:
    key = ["grid_id", "feature_timestamp"]
    spread = F.lit(0.0)
    for c in SIX_FEATURES:
        spread = F.greatest(spread, F.max(c) - F.min(c))
    per_key = (
        before.unionByName(after)
        .groupBy(*key)
        .agg(F.count("*").alias("n"), spread.alias("spread"))
    )
    return per_key.agg(
        F.count("*").alias("rows_compared"),
        F.count_if(F.col("n") != 2).alias("rows_on_one_side"),
        F.count_if(F.col("spread") > tolerance).alias("rows_changed"),
    )


def leakage_check(history: DataFrame, cut, tolerance: float = 1e-9) -> DataFrame:
    """Do features at or before ``cut`` stay the same when every later hour is altered?"""
    at = F.lit(cut).cast("timestamp")
    later = F.col("timestamp") > at
    altered = history.withColumns(
        {
            c: F.when(later, F.col(c) * 1000 + 99_999).otherwise(F.col(c))
            for c in ("internet_activity", "total_activity")
        }
    )

    def until(df):
        return features(df).filter(F.col("feature_timestamp") <= at)

    compared = _compare_features(until(history), until(altered), tolerance)
    bad = F.col("rows_on_one_side") + F.col("rows_changed")
    return compared.withColumn("leak_free", bad == 0)


def training_audit(history: DataFrame, training: DataFrame, k: int) -> DataFrame:
    """Recompute medians, targets and labels of a repeatable sample of rows from the hours themselves.

    Each drawn row meets the 24 hours up to its own and the one after: no frames, and only the cells and
    hours of the sample are read.
    """
    stored = ["trailing_median_24h", "target_activity", "high_activity"]
    drawn = audit_sample(training, k, "feature_timestamp").select("grid_id", "feature_timestamp", *stored)
    t = F.col("feature_timestamp")
    asked = drawn.select("grid_id", t, F.explode(F.sequence(F.lit(-23), F.lit(1))).alias("_ahead"))
    asked = asked.withColumn("timestamp", F.timestamp_seconds(F.unix_seconds(t) + F.col("_ahead") * 3600))
    near = asked.join(history.select("grid_id", "timestamp", "total_activity"), ["grid_id", "timestamp"], "left")
    past, value = F.col("_ahead") <= 0, F.col("total_activity")
    again = near.groupBy("grid_id", "feature_timestamp").agg(
        F.median(F.when(past, value)).alias("recomputed_median"),
        F.count_if(past & value.isNotNull()).alias("hours_found"),
        F.max(F.when(~past, value)).alias("recomputed_target"),
    )
    label = (F.col("recomputed_target") > 1.5 * F.col("recomputed_median")).cast("int")
    return drawn.join(again, ["grid_id", "feature_timestamp"]).select(
        *drawn.columns,
        "hours_found",
        "recomputed_median",
        "recomputed_target",
        label.alias("recomputed_label"),
        (
            (F.col("hours_found") == 24)
            & F.col("trailing_median_24h").eqNullSafe(F.col("recomputed_median"))
            & F.col("target_activity").eqNullSafe(F.col("recomputed_target"))
            & F.col("high_activity").eqNullSafe(label)
        ).alias("agrees"),
    )
