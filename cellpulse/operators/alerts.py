"""Rule-based alerts from one shuffle of the hourly table."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.columns import amount, count_where
from cellpulse.functions.quantiles import quantile_scalar
from cellpulse.schemas import ALERT_SCHEMA, ALERT_TYPES

HOURS_IN_DAY = 24


def _with_date(hourly: DataFrame) -> DataFrame:
    return hourly.select(
        "grid_id", "timestamp", F.to_date("timestamp").alias("date"), "total_activity"
    )


def daily_coverage(hourly: DataFrame) -> DataFrame:
    return (
        hourly.groupBy("grid_id", F.to_date("timestamp").alias("date"))
        .agg(F.countDistinct(F.hour("timestamp")).alias("hour_count"))
        .withColumn("complete_day", F.col("hour_count") == HOURS_IN_DAY)
    )


def daily_totals(hourly: DataFrame) -> DataFrame:
    """(cell, day, total): what the activity floor is a quantile of."""
    return (
        _with_date(hourly).groupBy("grid_id", "date").agg(F.sum("total_activity").alias("total"))
    )


def activity_floor(hourly: DataFrame, q: float = 0.10) -> DataFrame:
    """The exact q-quantile of all daily cell totals, one row."""
    totals = daily_totals(hourly)
    return totals.agg(F.count("*").alias("grid_days")).withColumn(
        "activity_floor", quantile_scalar(totals, "total", q)
    )


def _with_loo_median(df: DataFrame) -> DataFrame:
    """Median of the other hours of the same cell and day.

    With the day's values sorted, leaving one out only shifts the middle by at most one place.
    So three neighbouring order statistics of the day and a row's own rank are enough; no list
    of values is built. Lets a = the middle (rank n div 2), b and c = the next two:

    * n even, an odd number of others: the middle one is b for ranks up to a's, else a;
    * n odd, an even number of others: the two middle ones are two of a, b, c.
    """
    day = Window.partitionBy("grid_id", "date")
    rank = F.col("_rank")
    middle = F.floor(F.col("_n") / 2)

    def value_at(place):
        return F.max(F.when(rank == place, F.col("total_activity"))).over(day)

    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    odd_others = F.when(rank <= middle, b).otherwise(a)
    lower = F.when(rank <= middle, b).otherwise(a)
    upper = F.when(rank <= middle + 1, c).otherwise(b)
    return (
        df.withColumns(
            {
                "_rank": F.row_number().over(day.orderBy("total_activity", "timestamp")),
                "_n": F.count("*").over(day),
            }
        )
        .withColumns(
            {"_a": value_at(middle), "_b": value_at(middle + 1), "_c": value_at(middle + 2)}
        )
        .withColumn(
            "baseline_activity",
            F.when(F.col("_n") % 2 == 0, odd_others).when(F.col("_n") > 1, (lower + upper) / 2),
        )
        .drop("_a", "_b", "_c", "_rank")
    )


def loo_baseline(hourly: DataFrame, require_complete_day: bool = False) -> DataFrame:
    """Each hour with the median of the other hours of its day.

    A day group holds at most one row per hour. With ``require_complete_day`` the baseline needs
    all 23 others.
    """
    df = _with_loo_median(_with_date(hourly))
    if require_complete_day:
        whole = F.col("_n") == HOURS_IN_DAY
        df = df.withColumn("baseline_activity", F.when(whole, F.col("baseline_activity")))
    return df.select("grid_id", "timestamp", "total_activity", "baseline_activity")


def last_hours(hourly: DataFrame) -> DataFrame:
    """The newest row of each cell."""
    newest = F.max(F.struct("timestamp", "total_activity")).alias("_row")
    return hourly.groupBy("grid_id").agg(newest).select("grid_id", "_row.*")


def scored_hours(hourly: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Hourly rows with previous hour, day total, hours of the day and baseline.

    ``before`` has the row of each cell in front of these (see ``last_hours``), where they are not all of
    the history. The window over whole cells comes first: the later windows by (cell, day) then reuse its
    partitioning, so the table is shuffled once. A cell group holds one row per hour of ``hourly``.
    """
    cell = Window.partitionBy("grid_id").orderBy("timestamp")
    df = _with_date(hourly)
    if before is not None:
        df = df.withColumn("_own", F.lit(True)).unionByName(_with_date(before).withColumn("_own", F.lit(False)))
    df = df.withColumn("previous_activity", F.lag("total_activity").over(cell))
    if before is not None:
        df = df.filter("_own").drop("_own")
    return _with_loo_median(df).withColumn(
        "daily_total", F.sum("total_activity").over(Window.partitionBy("grid_id", "date"))
    )


def alerts(
    hourly: DataFrame,
    high: float = 1.5,
    spike: float = 1.5,
    drop: float = 0.5,
    require_complete_day: bool = True,
    severity=None,
    q: float = 0.10,
    before: DataFrame | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """HIGH_ACTIVITY, ACTIVITY_SPIKE and ACTIVITY_DROP records, any number per cell-hour.

    For a batch of whole days, ``before`` is the last row of each cell before it and ``totals`` are the
    ``daily_totals`` that the floor is taken from; without them ``hourly`` is all there is.
    ``severity`` is a column expression over the result for callers that grade alerts.
    """
    now, base, last = (F.col(c) for c in ("total_activity", "baseline_activity", "previous_activity"))

    def record(kind, condition, text):
        return F.when(
            condition, F.struct(F.lit(kind).alias("alert_type"), text.alias("reason"))
        )

    # The wording of the reasons.
    def sentence(bound, factor, what, reference):
        return F.concat(
            F.lit("Current activity "),
            amount(now),
            F.lit(f" is at {bound} {factor:.2f}x {what} "),
            amount(reference),
            F.lit("."),
        )

    day_text = "the within-day baseline"
    found = F.array_compact(
        F.array(
            record("HIGH_ACTIVITY", now >= high * base, sentence("least", high, day_text, base)),
            record(
                "ACTIVITY_SPIKE",
                last.isNotNull() & (now >= spike * last),
                sentence("least", spike, "the preceding hour", last),
            ),
            record("ACTIVITY_DROP", now <= drop * base, sentence("most", drop, day_text, base)),
        )
    )
    # A day is eligible when its total reaches the floor (and, by default, no hour is missing).
    totals = daily_totals(hourly) if totals is None else totals
    eligible = F.col("daily_total") >= quantile_scalar(totals, "total", q)
    if require_complete_day:
        eligible = eligible & (F.col("_n") == HOURS_IN_DAY)
    records = (
        scored_hours(hourly, before)
        .filter(eligible)
        .select(
            "grid_id",
            "timestamp",
            now.alias("current_activity"),
            base.alias("baseline_activity"),
            F.inline(found),
        )
    )
    columns = [F.col(c) for c in ALERT_SCHEMA.fieldNames()]
    return records.select(*columns, *([] if severity is None else [severity.alias("severity")]))


def alert_summary(hourly: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """Totals, distinct alerted cell-hours, their share, and counts by type, one row."""
    hours = hourly.agg(F.count("*")).scalar()
    per_hour = alert_rows.groupBy("grid_id", "timestamp").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("alert_type") == k).alias(k.lower()) for k in ALERT_TYPES],
    )
    names = [k.lower() for k in ALERT_TYPES]
    return (
        per_hour.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_alert_records"),
            F.count("*").alias("alerted_grid_hours"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names],
        )
        .withColumn("total_grid_hours", hours)
        .withColumn(
            "proportion_alerted",
            F.when(
                F.col("total_grid_hours") > 0,
                F.col("alerted_grid_hours") / F.col("total_grid_hours"),
            ).otherwise(0.0),
        )
    )


def alert_top_cells(alert_rows: DataFrame, n: int = 10) -> DataFrame:
    return (
        alert_rows.groupBy("grid_id")
        .agg(F.count("*").alias("alerts"))
        .orderBy(F.desc("alerts"), "grid_id")
        .limit(n)
    )


def alert_type_summary(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.groupBy("alert_type", "severity").agg(
        F.count("*").alias("alert_count"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def coerce_alerts(stored: DataFrame) -> DataFrame:
    """Types of the alert table for rows that come as text; what does not parse is null."""
    kinds = dict(stored.dtypes)
    ts = F.col("timestamp")
    ts = F.try_to_timestamp(ts) if kinds["timestamp"] == "string" else ts
    return stored.withColumns(
        {
            "grid_id": F.col("grid_id").try_cast("int"),
            "timestamp": ts,
            "current_activity": F.col("current_activity").try_cast("double"),
            "baseline_activity": F.col("baseline_activity").try_cast("double"),
        }
    )


def alert_load_checks(alert_rows: DataFrame) -> DataFrame:
    """Nulls that may not be (the baseline may), unknown types, repeats of the natural key."""
    a = coerce_alerts(alert_rows)
    required = ["grid_id", "timestamp", "alert_type", "current_activity", "reason"]
    repeats = a.groupBy("grid_id", "timestamp", "alert_type").count()
    return a.agg(
        F.count("*").alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
        count_where(~F.col("alert_type").isin(ALERT_TYPES)).alias("unknown_types"),
    ).withColumn(
        "repeated_rows", repeats.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).scalar()
    )
