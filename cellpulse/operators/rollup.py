"""Roll-ups. Every sum is combined map-side before it is shuffled."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.columns import safe_ratio
from cellpulse.operators.clean import with_totals
from cellpulse.schemas import CHANNELS


def _sum(column, name=None):
    return F.sum(column).alias(name or column)


def hourly_summary(cleaned: DataFrame) -> DataFrame:
    """One row per (hour, cell): country rows are added up, totals and internet share follow."""
    per_hour = cleaned.groupBy("timestamp", "grid_id").agg(*[_sum(c) for c in CHANNELS])
    share = safe_ratio(F.col("internet_activity"), F.col("total_activity"))
    return with_totals(per_hour).withColumns(
        {"internet_share": share, "date": F.to_date("timestamp")}
    )


def daily_summary(hourly: DataFrame) -> DataFrame:
    return (
        hourly.groupBy("date", "grid_id")
        .agg(
            _sum("total_activity", "daily_activity"),
            _sum("total_sms", "daily_sms"),
            _sum("total_calls", "daily_calls"),
            _sum("internet_activity", "daily_internet"),
            F.avg("total_activity").alias("daily_avg_activity"),
            F.max("total_activity").alias("daily_max_activity"),
            F.min("total_activity").alias("daily_min_activity"),
        )
        .withColumn(
            "internet_share", safe_ratio(F.col("daily_internet"), F.col("daily_activity"))
        )
    )


def daily_share(hourly: DataFrame) -> DataFrame:
    """Each hour beside its cell's day total; a window instead of a self-join."""
    day = Window.partitionBy("grid_id", "date")
    return (
        hourly.select("timestamp", "grid_id", "date", "total_activity", "internet_activity")
        .withColumns(
            {
                "daily_activity": F.sum("total_activity").over(day),
                "daily_internet": F.sum("internet_activity").over(day),
            }
        )
        .withColumns(
            {
                "share_of_day": safe_ratio(F.col("total_activity"), F.col("daily_activity")),
                "daily_internet_share": safe_ratio(
                    F.col("daily_internet"), F.col("daily_activity")
                ),
            }
        )
    )


def daily_network(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("date").agg(
        _sum("total_sms"),
        _sum("total_calls"),
        _sum("internet_activity"),
        _sum("total_activity"),
        F.countDistinct("grid_id").alias("unique_grids"),
    )


def grid_summary(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("grid_id").agg(
        _sum("total_sms"),
        _sum("total_calls"),
        _sum("internet_activity"),
        _sum("total_activity"),
        F.countDistinct("timestamp").alias("active_hours"),
    )


def dashboard_hourly(hourly: DataFrame, split_channels: bool = False) -> DataFrame:
    if split_channels:
        sums = [_sum("total_activity")] + [
            _sum(c, f"total_{c}") for c in CHANNELS
        ]
    else:
        sums = [
            _sum("total_activity"),
            _sum("total_sms"),
            _sum("total_calls"),
            _sum("internet_activity"),
        ]
    return hourly.groupBy("timestamp").agg(
        *sums, F.countDistinct("grid_id").alias("active_grid_count")
    )


def hour_sums(value="total_activity", ts="timestamp", where=None) -> list:
    """24 sums of a measure by hour of the day, null for hours without rows."""
    where = F.lit(True) if where is None else where
    return [F.sum(F.when(where & (F.hour(ts) == h), F.col(value))).alias(f"_h{h}") for h in range(24)]


def busiest_hour():
    """Aggregate over frames with ``hour_sums``: the hour with the largest sum, the first among equals."""
    totals = [F.struct(F.sum(f"_h{h}").alias("t"), F.lit(-h).alias("h")) for h in range(24)]
    known = F.filter(F.array(*totals), lambda r: r["t"].isNotNull())
    return -F.array_max(known)["h"]


def kpis(raw: DataFrame, cleaned: DataFrame, hourly: DataFrame) -> DataFrame:
    """One row. The hourly table is read once: cells first, with a sum per hour of the day each."""
    n_raw = raw.agg(F.count("*")).scalar()
    n_clean = cleaned.agg(F.count("*")).scalar()
    sums = ["total_sms", "total_calls", "total_activity"]
    cells = hourly.groupBy("grid_id").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        *[_sum(c) for c in sums], *hour_sums(),
    )
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("grid_hour_rows"),
        F.count("grid_id").alias("unique_grids"),
        F.min("first").alias("time_start"),
        F.max("last").alias("time_end"),
        *[_sum(c) for c in sums],
        busiest_hour().alias("busiest_hour"),
        F.max_by("grid_id", F.struct(F.col("total_activity"), -F.col("grid_id"))).alias("busiest_grid"),
    ).withColumns({"input_rows": n_raw, "cleaned_rows": n_clean})


def profile(raw: DataFrame) -> DataFrame:
    """Facts about a raw batch: size, spread, span, cadence and repeats at the source grain.

    Rows are added up per grain once, and all but the number of files follows from that. Distinct cells,
    countries and hours are gathered as sets: they are as many as the map, the world and the history have.
    """
    grain = raw.groupBy("datetime", "CellID", "countrycode").agg(F.count("*").alias("n"))
    files = raw.select("_source_file").distinct().agg(F.count("_source_file")).scalar()
    facts = grain.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"),
        F.size(F.collect_set("CellID")).cast("long").alias("unique_cells"),
        F.size(F.collect_set("countrycode")).cast("long").alias("unique_countries"),
        F.sort_array(F.collect_set("datetime")).alias("_hours"),
    )
    seconds = F.transform("_hours", F.unix_seconds)
    steps = F.zip_with(
        F.slice(seconds, F.lit(2), F.greatest(F.size(seconds) - 1, F.lit(0))),
        F.slice(seconds, F.lit(1), F.greatest(F.size(seconds) - 1, F.lit(0))),
        lambda later, earlier: (later - earlier) / 3600,
    )
    # The most frequent step, the smallest among equals.
    kinds = F.transform(
        F.array_distinct("_steps"),
        lambda h: F.struct(F.size(F.filter("_steps", lambda s: s == h)).alias("n"), (-h).alias("h")),
    )
    return facts.withColumn("_steps", steps).select(
        files.alias("files"),
        "total_rows",
        "unique_cells",
        "unique_countries",
        F.size("_hours").cast("long").alias("unique_hours"),
        F.get("_hours", F.lit(0)).alias("time_start"),
        F.get("_hours", F.size("_hours") - 1).alias("time_end"),
        F.lit(len(raw.columns) - 1).alias("total_columns"),
        (-F.array_max(kinds)["h"]).alias("cadence_hours"),
        "repeated_rows",
    )


def multi_country(cleaned: DataFrame) -> DataFrame:
    """(hour, cell) groups that hold more than one country."""
    return (
        cleaned.groupBy("timestamp", "grid_id")
        .agg(F.countDistinct("country_code").alias("countries"), F.count("*").alias("source_rows"))
        .filter(F.col("countries") > 1)
    )


def country_freq(df: DataFrame, column: str = "country_code") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("frequency"))


def grain_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key groups that occur more than once; empty means the grain holds."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def peak_hour(hourly: DataFrame) -> DataFrame:
    """The hour with the largest sum over all cells."""
    return (
        hourly.groupBy("timestamp")
        .agg(F.sum("total_activity").alias("network_activity"))
        .orderBy(F.desc("network_activity"), "timestamp")
        .limit(1)
    )


def peak_per_grid(hourly: DataFrame) -> DataFrame:
    """Each cell's strongest hour, the earliest among equals; one small state per cell."""
    best = F.max(F.struct("total_activity", (-F.unix_seconds("timestamp")).alias("early")))
    return hourly.groupBy("grid_id").agg(best.alias("b")).select(
        "grid_id",
        F.timestamp_seconds(-F.col("b.early")).alias("peak_activity_hour"),
        F.col("b.total_activity").alias("peak_activity"),
    )


def overall_peak(hourly: DataFrame) -> DataFrame:
    return (
        hourly.select("grid_id", "timestamp", "total_activity")
        .orderBy(F.desc("total_activity"), "timestamp", "grid_id")
        .limit(1)
    )


def hotspots(hourly: DataFrame, start=None, end=None, n: int = 10) -> DataFrame:
    """Top cells by total activity, optionally inside an inclusive date window."""
    if start is not None:
        hourly = hourly.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        hourly = hourly.filter(F.col("date") <= F.lit(end).cast("date"))
    return (
        hourly.groupBy("grid_id")
        .agg(F.sum("total_activity").alias("total_activity"))
        .orderBy(F.desc("total_activity"), "grid_id")
        .limit(n)
    )


def hotspot_rank(hourly: DataFrame, n: int | None = None) -> DataFrame:
    """Cells ranked inside each hour. A group holds at most one row per cell of the map."""
    order = Window.partitionBy("timestamp").orderBy(F.desc("total_activity"), "grid_id")
    ranked = hourly.select("timestamp", "date", "grid_id", "total_activity").withColumn(
        "hotspot_rank", F.row_number().over(order)
    )
    return ranked if n is None else ranked.filter(F.col("hotspot_rank") <= n)


def hotspot_ratio(scored: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Activity against the expected baseline; a flag says unusually high, nothing more."""
    ratio = F.when(
        F.col("baseline_activity") > 0, F.col("total_activity") / F.col("baseline_activity")
    )
    return scored.select("grid_id", "timestamp", "total_activity", "baseline_activity").withColumns(
        {
            "activity_ratio": ratio,
            "hotspot_flag": F.coalesce(ratio >= threshold, F.lit(False)),
        }
    )
