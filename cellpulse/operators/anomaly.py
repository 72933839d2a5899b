"""Same-hour-of-day anomalies: each hour against the median of the earlier days.

A growing median is kept as state: per (cell, hour of day) the sorted values of all days so far, one row.
New days are scored against it and merged into it, so a run costs what is new and one pass over the state.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.functions.columns import amount, count_where, percent_text
from cellpulse.operators.checks import audit_sample

BUCKET = ["grid_id", "hour_of_day"]
#: Days that are scored against one sorted state. Small: each row sorts some two blocks of values.
BLOCK_DAYS = 16


def _buckets(hourly: DataFrame) -> DataFrame:
    return hourly.select(
        "grid_id", "timestamp", F.hour("timestamp").alias("hour_of_day"), "total_activity"
    )


def order_state(hourly: DataFrame) -> DataFrame:
    """(cell, hour of day) with the sorted values of all its days: one value per day of history."""
    return _buckets(hourly).groupBy(*BUCKET).agg(F.sort_array(F.collect_list("total_activity")).alias("past"))


def merge_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """The state with later hours added. Two sorted lists per bucket become one."""
    both = state.unionByName(order_state(new))
    return both.groupBy(*BUCKET).agg(F.sort_array(F.flatten(F.collect_list("past"))).alias("past"))


def _values(rows):
    """Values of an array of rows, without nulls."""
    return F.filter(F.transform(rows, lambda r: r["total_activity"]), lambda v: v.isNotNull())


def _with_baseline(rows: DataFrame, block: int) -> DataFrame:
    """``baseline_count`` and ``historical_baseline`` of (bucket, past, rows in time order).

    The new rows of a bucket are taken ``block`` at a time. In front of a block all earlier values are
    sorted once. While the block's rows come in, the median moves by at most half a block, so a row needs
    the values of ``past`` around the middle and the earlier rows of its own block, and no list grows
    with the history: lo values of ``past`` are left out below, and a median of rank r among all is of
    rank r - lo among the rest.
    """
    last = F.floor((F.size("rows") - 1) / block)
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("_block"))
    done = F.col("_block") * block
    blocks = blocks.select(
        *BUCKET,
        F.slice("rows", done + 1, F.lit(block)).alias("_mine"),
        F.sort_array(F.concat("past", _values(F.slice("rows", F.lit(1), done)))).alias("_before"),
    )
    blocks = blocks.withColumn("_n", F.size("_before"))
    blocks = blocks.withColumn("_lo", F.greatest(F.lit(0), F.floor((F.col("_n") - block) / 2).cast("int") - 1))
    blocks = blocks.select(
        *BUCKET, "_mine", "_n", "_lo", F.slice("_before", F.col("_lo") + 1, F.lit(block + 4)).alias("_middle")
    )
    each = blocks.select("*", F.posexplode("_mine").alias("_place", "_row"))
    each = each.withColumn("_seen", _values(F.slice("_mine", F.lit(1), F.col("_place"))))
    each = each.withColumn("baseline_count", F.col("_n") + F.size("_seen"))
    each = each.withColumn("_near", F.sort_array(F.concat("_middle", "_seen")))

    def ranked(rank):
        # A rank below 0, of an empty history, reads as null.
        return F.get("_near", (F.floor(rank) - F.col("_lo")).cast("int"))

    n = F.col("baseline_count")
    return each.select(
        "grid_id",
        F.col("_row.timestamp").alias("timestamp"),
        "hour_of_day",
        F.col("_row.total_activity").alias("total_activity"),
        "baseline_count",
        ((ranked((n - 1) / 2) + ranked(n / 2)) / 2).alias("historical_baseline"),
    )


def _in_order(hourly: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("timestamp", "total_activity")))
    return _buckets(hourly).groupBy(*BUCKET).agg(rows.alias("rows"))


def anomalies(
    hourly: DataFrame, min_history: int = 3, threshold: float = 0.5, block: int = BLOCK_DAYS
) -> DataFrame:
    """Every cell-hour with baseline, deviation, direction, flag, reason and action."""
    rows = _in_order(hourly).withColumn("past", F.array().cast("array<double>"))
    return _judged(_with_baseline(rows, block), min_history, threshold)


def anomalies_increment(
    state: DataFrame, new: DataFrame, min_history: int = 3, threshold: float = 0.5, block: int = BLOCK_DAYS
) -> DataFrame:
    """``anomalies`` for new hours alone, all later than those in ``state`` (see ``order_state``)."""
    rows = _in_order(new).join(state, BUCKET, "left")
    rows = rows.withColumn("past", F.coalesce("past", F.array().cast("array<double>")))
    return _judged(_with_baseline(rows, block), min_history, threshold)


def _judged(df: DataFrame, min_history: int, threshold: float) -> DataFrame:
    """Deviation, direction, flag, reason and action of rows with their baselines."""
    known = F.col("baseline_count") >= min_history
    base = F.col("historical_baseline")
    df = df.withColumn("historical_baseline", F.when(known, base))
    df = df.withColumn(
        "deviation", F.when(base != 0, (F.col("total_activity") - base) / base)
    )
    deviation = F.col("deviation")
    direction = (
        F.when(deviation.isNull(), "UNKNOWN")
        .when(deviation >= threshold, "HIGH")
        .when(deviation <= -threshold, "LOW")
        .otherwise("NORMAL")
    )
    odd = F.col("anomaly_direction").isin("HIGH", "LOW")
    return (
        df.withColumns({"anomaly_score": F.abs(deviation), "anomaly_direction": direction})
        .withColumns(
            {
                "anomaly_flag": odd.cast("int"),
                "reason": _reason(min_history),
                "recommended_action": F.when(odd, "INVESTIGATE").otherwise("NONE"),
            }
        )
        .select(
            "grid_id",
            "timestamp",
            "hour_of_day",
            "total_activity",
            "historical_baseline",
            "baseline_count",
            "deviation",
            "anomaly_score",
            "anomaly_direction",
            "anomaly_flag",
            "reason",
            "recommended_action",
        )
    )


def _reason(min_history: int):
    # The wording of the reasons.
    place = F.format_string("grid %d at hour %02d", "grid_id", "hour_of_day")
    pct = percent_text(F.abs("deviation"))
    count = F.col("baseline_count").cast("string")

    def off(side):
        return F.concat(
            F.lit("Activity is "),
            pct,
            F.lit(f"% {side} the historical baseline for "),
            place,
            F.lit(" (baseline="),
            amount(F.col("historical_baseline")),
            F.lit(", history_count="),
            count,
            F.lit(")."),
        )

    usual = F.concat(
        F.lit("Activity is within the historical range for "),
        place,
        F.lit(" ("),
        pct,
        F.lit("% absolute deviation)."),
    )
    too_little = F.concat(
        F.lit("Insufficient historical observations to establish a reliable baseline for "),
        place,
        F.lit(" (history_count="),
        count,
        F.lit(f"; minimum_required={min_history})."),
    )
    direction = F.col("anomaly_direction")
    return (
        F.when(direction == "HIGH", off("above"))
        .when(direction == "LOW", off("below"))
        .when(direction == "NORMAL", usual)
        .otherwise(too_little)
    )


def bucket_rows(hourly: DataFrame) -> DataFrame:
    """Observations per (cell, hour of day)."""
    return _buckets(hourly).groupBy(*BUCKET).agg(F.count("*").alias("bucket_count"))


def bucket_coverage(
    hourly: DataFrame, expected_cells, min_history: int = 3
) -> DataFrame:
    """``expected_cells``: a number, or a scalar column such as the length of a look-up."""
    expected = F.lit(expected_cells) * 24
    return bucket_rows(hourly).agg(
        F.count("*").alias("buckets"),
        F.min("bucket_count").alias("min_rows"),
        F.max("bucket_count").alias("max_rows"),
        F.avg("bucket_count").alias("mean_rows"),
        F.count_if(F.col("bucket_count") < min_history).alias("low_history_buckets"),
        expected.cast("long").alias("expected_buckets"),
        (expected - F.count("*")).cast("long").alias("missing_buckets"),
    )


def low_history_buckets(hourly: DataFrame, min_history: int = 3) -> DataFrame:
    return bucket_rows(hourly).filter(F.col("bucket_count") < min_history)


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Rows per direction, flag and action, with the nulls of the columns that may be null."""
    return scored.groupBy("anomaly_direction", "anomaly_flag", "recommended_action").agg(
        F.count("*").alias("n_rows"),
        *[
            F.count_if(F.col(c).isNull()).alias(f"null_{c}")
            for c in ("historical_baseline", "deviation", "anomaly_score")
        ],
    )


def anomaly_checks(scored: DataFrame, min_history: int = 3) -> DataFrame:
    """Violations that should all be zero, one row."""
    starts = scored.groupBy(*BUCKET).agg(F.min("baseline_count").alias("first"))
    known = F.col("historical_baseline").isNotNull()
    return scored.agg(
        F.count("*").alias("total_rows"),
        count_where(F.hour("timestamp") != F.col("hour_of_day")).alias("hour_mismatches"),
        F.count_if(known & (F.col("baseline_count") < min_history)).alias("baseline_too_early"),
        F.count_if(~known & (F.col("baseline_count") >= min_history)).alias("baseline_missing"),
        F.count_if(F.col("reason").isNull()).alias("missing_reasons"),
    ).withColumn("buckets_not_from_zero", starts.agg(F.count_if(F.col("first") != 0)).scalar())


def baseline_audit(hourly: DataFrame, scored: DataFrame, k: int, min_history: int = 3) -> DataFrame:
    """Recompute the baselines of a repeatable sample of rows from their own earlier hours.

    Only the buckets of the sample are read; each drawn row meets its bucket's earlier rows, one a day.
    """
    drawn = audit_sample(scored.select("grid_id", "timestamp", "historical_baseline"), k)
    asked = drawn.withColumn("hour_of_day", F.hour("timestamp"))
    earlier = _buckets(hourly).select(*BUCKET, F.col("timestamp").alias("_t"), F.col("total_activity").alias("_v"))
    met = asked.join(earlier, [*(asked[c] == earlier[c] for c in BUCKET), F.col("_t") < F.col("timestamp")], "left")
    again = met.groupBy(asked["grid_id"], "timestamp", "historical_baseline").agg(
        F.count("_v").alias("_n"), F.median("_v").alias("_median")
    )
    recomputed = F.when(F.col("_n") >= min_history, F.col("_median"))
    return again.select(
        "grid_id",
        "timestamp",
        "historical_baseline",
        recomputed.alias("recomputed"),
        F.col("historical_baseline").eqNullSafe(recomputed).alias("agrees"),
    )
