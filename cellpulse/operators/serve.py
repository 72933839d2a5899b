"""The served questions, each for a batch of requests instead of one at a time."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.asof import as_of_join
from cellpulse.functions.columns import (
    hours_between,
    not_finite,
    safe_ratio,
    status_of_severity,
    status_rank,
)
from cellpulse.operators.rollup import busiest_hour, hour_sums
from cellpulse.schemas import MAX_CELL, MIN_CELL, SEVERITIES


def _moment(df: DataFrame, as_of, ts: str = "timestamp"):
    """``as_of`` as a column; without one the newest time of the frame."""
    return df.agg(F.max(ts)).scalar() if as_of is None else F.lit(as_of).cast("timestamp")


def network_summary(history: DataFrame, as_of=None, strict_as_of: bool = False) -> DataFrame:
    """One row on the network. By default total and peak hour cover all hours, the active cells
    the hour ``as_of`` and the top cell the hours up to it; ``strict_as_of`` limits all to it."""
    moment = _moment(history, as_of)
    known = F.col("_known")
    inside = known if strict_as_of else F.lit(True)
    value = F.col("total_activity")
    # Cells first, with a sum per hour of the day each: one pass for all fields.
    cells = (
        history.withColumns({"_known": F.col("timestamp") <= moment, "_now": F.col("timestamp") == moment})
        .groupBy("grid_id")
        .agg(
            F.sum(F.when(inside, value)).alias("t"),
            F.sum(F.when(known, value)).alias("upto"),
            F.count_if(F.col("_now") & (value > 0)).alias("active"),
            *hour_sums(where=inside),
        )
    )
    return cells.agg(
        F.coalesce(F.sum("t"), F.lit(0.0)).alias("total_activity"),
        F.coalesce(F.sum("active"), F.lit(0)).alias("active_grids"),
        busiest_hour().alias("peak_hour"),
        F.max_by("grid_id", F.when(F.col("upto").isNotNull(), F.struct(F.col("upto"), -F.col("grid_id")))).alias("top_grid"),
    ).withColumn("as_of", moment)


def grid_activity(
    history: DataFrame,
    cells: list[int] | None = None,
    as_of=None,
    from_date=None,
    date=None,
    hour: int | None = None,
) -> DataFrame:
    """Activity of cells up to ``as_of``: the trailing 24 hours, or one date, or one hour of the
    day on all dates, or with ``from_date`` that hour from the date on."""
    for cell in cells or []:
        if not MIN_CELL <= cell <= MAX_CELL:
            raise ValueError(f"cell {cell} is not on the map ({MIN_CELL} to {MAX_CELL})")
    moment = _moment(history, as_of)
    t = F.col("timestamp")
    rows = history.filter(t <= moment)
    if date is None and from_date is None and hour is None:
        rows = rows.filter(t >= moment - F.make_dt_interval(hours=F.lit(23)))
    if date is not None:
        rows = rows.filter(F.to_date(t) == F.lit(date).cast("date"))
    if from_date is not None:
        rows = rows.filter(F.to_date(t) >= F.lit(from_date).cast("date"))
    if hour is not None:
        rows = rows.filter(F.hour(t) == hour)
    if cells is not None:
        rows = rows.filter(F.col("grid_id").isin(cells))
    return rows.select(
        "grid_id",
        "timestamp",
        F.hour(t).alias("hour_of_day"),
        "total_sms",
        "total_calls",
        "internet_activity",
        "total_activity",
    )


def features_as_of(stored: DataFrame, requests: DataFrame, latest) -> DataFrame:
    """Newest stored feature row per request, its quality and its age against ``latest``."""
    found = as_of_join(stored, requests, "feature_timestamp")
    values = [c for c in stored.columns if c not in ("grid_id", "feature_timestamp")]
    doubles = [n for n, kind in stored.dtypes if kind == "double"]

    def any_of(conditions):
        return reduce(lambda a, b: a | b, conditions)

    t = F.col("feature_timestamp")
    age = hours_between(latest, t)
    quality = (
        F.when(t.isNull(), "NOT FOUND")
        .when(any_of([F.col(c).isNull() for c in values]), "INCOMPLETE")
        .when(any_of([not_finite(F.col(c)) for c in doubles]), "NON-FINITE")
        .otherwise("GOOD")
    )
    freshness = (
        F.when(t >= latest, "CURRENT").when(age <= 24, "RECENT").when(age > 24, "STALE")
    )
    return found.withColumns({"data_quality": quality, "feature_freshness": freshness})


def anomaly_as_of(scored: DataFrame, requests: DataFrame) -> DataFrame:
    return as_of_join(scored, requests, "timestamp")


def _severity(value):
    if value is None:
        return None
    if value.upper() not in SEVERITIES:
        raise ValueError(f"severity is one of {', '.join(SEVERITIES)}")
    return value.upper()


def _positive(limit: int) -> int:
    if limit < 1:
        raise ValueError("a limit is at least 1")
    return limit


def _alerts_upto(alert_rows, as_of, severity):
    rows = alert_rows.filter(F.col("timestamp") <= _moment(alert_rows, as_of))
    level = _severity(severity)
    return rows if level is None else rows.filter(F.col("severity") == level)


def alerts_feed(
    alert_rows: DataFrame, as_of=None, severity=None, alert_type=None, limit: int = 100
) -> DataFrame:
    """Newest alerts first."""
    rows = _alerts_upto(alert_rows, as_of, severity)
    if alert_type is not None:
        rows = rows.filter(F.col("alert_type") == alert_type)
    return rows.orderBy(F.desc("timestamp"), "grid_id", "alert_type").limit(_positive(limit))


def alert_hotspots(alert_rows: DataFrame, as_of=None, severity=None, limit: int = 100) -> DataFrame:
    """All alerts of each cell's latest alerted hour, strongest first."""
    rows = _alerts_upto(alert_rows, as_of, severity)
    newest = rows.groupBy("grid_id").agg(F.max("timestamp").alias("timestamp"))
    return (
        rows.join(newest, ["grid_id", "timestamp"], "left_semi")
        .orderBy(F.desc("current_activity"), F.desc("timestamp"), "grid_id", "alert_type")
        .limit(_positive(limit))
    )


def grid_location(grids: DataFrame, requests: DataFrame) -> DataFrame:
    """Centroid and geometry reference of the cells asked for; unknown cells stay, with nulls."""
    place = grids.select(
        "grid_id", "centroid_latitude", "centroid_longitude", "geometry_ref"
    ).withColumn("found", F.lit(True))
    return requests.join(place, "grid_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def _stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Totals, average, peak (the earliest hour among equals) and per-channel averages."""
    t, when = F.col("total_activity"), -F.unix_seconds("timestamp")
    channels = {"sms": "total_sms", "calls": "total_calls", "internet": "internet_activity"}
    spread = []
    for name, c in channels.items():
        spread += [
            F.sum(c).alias(f"{name}_total"),
            F.avg(c).alias(f"{name}_avg"),
            F.max(c).alias(f"{name}_peak"),
        ]
    peak = F.max(F.struct(t.alias("v"), when.alias("w"))).alias("_peak")
    return (
        rows.groupBy(*by)
        .agg(F.sum(t).alias("total"), F.avg(t).alias("average"), *spread, peak)
        .withColumns(
            {
                "peak": F.col("_peak.v"),
                "peak_hour": F.hour(F.timestamp_seconds(-F.col("_peak.w"))),
            }
        )
        .drop("_peak")
    )


def grid_stats(rows: DataFrame) -> DataFrame:
    return _stats(rows, ["grid_id"])


def composition(rows: DataFrame) -> DataFrame:
    """Share of each traffic kind per cell; kinds without traffic are left out."""
    kinds = {"Calls": "total_calls", "SMS": "total_sms", "Internet": "internet_activity"}
    sums = rows.groupBy("grid_id").agg(*[F.sum(c).alias(c) for c in kinds.values()])
    whole = reduce(lambda a, b: a + b, [F.col(c) for c in kinds.values()])
    parts = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("amount")) for k, c in kinds.items()]
    )
    return (
        sums.select("grid_id", whole.alias("whole"), F.inline(parts))
        .filter(F.col("amount") > 0)
        .select("grid_id", "kind", "amount", safe_ratio(F.col("amount"), F.col("whole")).alias("share"))
    )


def _difference():
    """Percent by which the larger total exceeds the smaller; 100 when the smaller is 0."""
    low = F.least("total_a", "total_b")
    high = F.greatest("total_a", "total_b")
    return F.when(low > 0, (high - low) / low * 100).otherwise(100.0)


_COMPARED = ["total", "average", "peak", "peak_hour"]


def _side(stats: DataFrame, names: dict, suffix: str) -> DataFrame:
    return stats.select(
        *[F.col(c).alias(n) for c, n in names.items()],
        *[F.col(c).alias(f"{c}_{suffix}") for c in _COMPARED],
    )


def compare_grids(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grid_a, grid_b) pairs side by side."""
    stats = grid_stats(rows)
    both = pairs.join(_side(stats, {"grid_id": "grid_a"}, "a"), "grid_a").join(
        _side(stats, {"grid_id": "grid_b"}, "b"), "grid_b"
    )
    return both.withColumns(
        {
            "difference_pct": _difference(),
            "higher": F.when(F.col("total_a") >= F.col("total_b"), "A").otherwise("B"),
            "meaningful": (F.col("total_a") != 0) | (F.col("total_b") != 0),
        }
    )


def _of_date(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.to_date("timestamp"))


def compare_days(rows: DataFrame, pairs: DataFrame, recurring_below: float = 15.0) -> DataFrame:
    """(grid_id, date_a, date_b) triples side by side; close totals look like a pattern."""
    stats = _stats(_of_date(rows), ["grid_id", "day"])
    both = pairs.join(
        _side(stats, {"grid_id": "grid_id", "day": "date_a"}, "a"), ["grid_id", "date_a"]
    ).join(_side(stats, {"grid_id": "grid_id", "day": "date_b"}, "b"), ["grid_id", "date_b"])
    return both.withColumn("difference_pct", _difference()).withColumn(
        "recurring", F.col("difference_pct") < recurring_below
    )


def compare_days_hourly(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The two days of each triple hour by hour over all 24 hours, null where an hour is absent."""
    slots = pairs.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    hours = _of_date(rows).select("grid_id", "day", F.hour("timestamp").alias("hour"), "total_activity")

    def side(name):
        return hours.select(
            "grid_id",
            F.col("day").alias(f"date_{name}"),
            "hour",
            F.col("total_activity").alias(name),
        )

    return slots.join(side("a"), ["grid_id", "date_a", "hour"], "left").join(
        side("b"), ["grid_id", "date_b", "hour"], "left"
    )


def alert_context(alert_rows: DataFrame, scored: DataFrame, medians: DataFrame) -> DataFrame:
    """Each alert with its deviation, the anomaly score of the same hour and the day's median.

    ``medians`` are trailing medians keyed by ``feature_timestamp``.
    """
    anomaly = scored.select("grid_id", "timestamp", "anomaly_flag", "anomaly_direction", "deviation")
    median = medians.select(
        "grid_id", F.col("feature_timestamp").alias("timestamp"), "trailing_median_24h"
    )
    base = F.col("baseline_activity")
    return (
        alert_rows.join(anomaly, ["grid_id", "timestamp"], "left")
        .join(median, ["grid_id", "timestamp"], "left")
        .withColumns(
            {
                "deviation_pct": F.when(base != 0, (F.col("current_activity") - base) * 100 / base),
                "corroborated": F.coalesce(F.col("anomaly_flag") == 1, F.lit(False)),
            }
        )
    )


def alert_status_map(alert_rows: DataFrame) -> DataFrame:
    """Worst status and the distinct alert types per cell."""
    rank = status_rank(status_of_severity(F.col("severity")))
    return (
        alert_rows.groupBy("grid_id")
        .agg(
            F.max(rank).alias("status_rank"),
            F.array_join(F.array_sort(F.collect_set("alert_type")), ", ").alias("alert_types"),
        )
        .withColumn(
            "status",
            F.when(F.col("status_rank") == 3, "HIGH")
            .when(F.col("status_rank") == 2, "ATTENTION")
            .otherwise("NORMAL"),
        )
    )


def evidence_summary(rows: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """Per cell: how many hours, average, lowest, highest and latest with their times, and how many
    alerts there were before the latest hour."""
    v, t = F.col("total_activity"), F.col("timestamp")
    early = -F.unix_seconds(t)
    seen = rows.groupBy("grid_id").agg(
        F.count("*").alias("observations"),
        F.avg(v).alias("average_activity"),
        F.min(F.struct(v.alias("v"), t.alias("t"))).alias("lo"),
        F.max(F.struct(v.alias("v"), early.alias("t"))).alias("hi"),
        F.max(F.struct(t.alias("t"), v.alias("v"))).alias("new"),
    )
    prior = (
        alert_rows.join(seen.select("grid_id", F.col("new.t").alias("_incident")), "grid_id")
        .filter(F.col("timestamp") < F.col("_incident"))
        .groupBy("grid_id")
        .agg(F.count("*").alias("n"))
    )
    return seen.join(prior, "grid_id", "left").select(
        "grid_id",
        "observations",
        "average_activity",
        F.col("lo.v").alias("minimum_activity"),
        F.col("lo.t").alias("minimum_at"),
        F.col("hi.v").alias("maximum_activity"),
        F.timestamp_seconds(-F.col("hi.t")).alias("maximum_at"),
        F.col("new.v").alias("latest_activity"),
        F.col("new.t").alias("latest_at"),
        F.coalesce("n", F.lit(0)).alias("prior_alerts"),
    )
