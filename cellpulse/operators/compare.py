"""Where the three detectors agree: next-hour model, same-hour anomalies, rule alerts.

The class names are fixed values. In them ML3 stands for the model, ML4 for the anomalies and
NP3 for the rules.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.quantiles import exact_quantiles
from cellpulse.functions.unique import one_row_per

KEY = ["grid_id", "timestamp"]
PROFILE_COLUMNS = [
    "peak_ratio",
    "activity_growth",
    "trailing_median_24h",
    "target_activity",
    "ml_prediction_probability",
    "deviation",
    "historical_baseline",
]
HIGH_GROUPS = ["BOTH_HIGH", "ML3_HIGH_ONLY", "ML4_HIGH_ONLY", "NEITHER_HIGH"]
CATEGORY_COLUMNS = [
    "agreement_category",
    "direction_category",
    "high_comparison_group",
    "ml_vs_rule_high",
    "ml_vs_rule_spike",
    "three_way_high_category",
    "three_way_spike_category",
]


def _two_way(first, second, both, first_only, second_only, neither="NEITHER"):
    return (
        F.when(first & second, both)
        .when(first, first_only)
        .when(second, second_only)
        .otherwise(neither)
    )


def _three_way(ml3, ml4, np3):
    """Eight classes named after the detectors that fired."""
    names = F.array_compact(
        F.array(F.when(ml3, "ML3"), F.when(ml4, "ML4"), F.when(np3, "NP3"))
    )
    return (
        F.when(F.size(names) == 3, "ALL_THREE")
        .when(F.size(names) == 0, "NONE")
        .otherwise(F.concat(F.array_join(names, "_"), F.lit("_ONLY")))
    )


def alert_indicators(alert_rows: DataFrame) -> DataFrame:
    """One row per alerted cell-hour with 0/1 flags, so that the join stays one-to-one."""

    def flag(kind):
        return F.max((F.col("alert_type") == kind).cast("int"))

    high = F.col("alert_type") == "HIGH_ACTIVITY"
    return alert_rows.groupBy(*KEY).agg(
        flag("HIGH_ACTIVITY").alias("np3_high"),
        flag("ACTIVITY_SPIKE").alias("np3_spike"),
        F.max(F.when(high, F.col("baseline_activity"))).alias("np3_baseline_activity"),
    )


def _with_alerts(df: DataFrame, alert_rows: DataFrame) -> DataFrame:
    return df.join(alert_indicators(alert_rows), KEY, "left").na.fill(
        0, ["np3_high", "np3_spike"]
    )


def detector_compare(predictions: DataFrame, scored: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """Predictions at their target hour beside the anomaly and the alerts of that hour.

    ``predictions`` has ``ml_prediction`` and ``ml_prediction_probability``. Predictions and anomalies are
    one per (grid_id, timestamp); a key that occurs twice is an error. Each table is dealt by that key once,
    or not at all where it is stored in buckets of it (``files.write_bucketed``).
    """
    anomaly = scored.select(
        *KEY,
        "hour_of_day",
        "total_activity",
        "historical_baseline",
        "deviation",
        "anomaly_direction",
        "anomaly_flag",
    )
    both = one_row_per(predictions, KEY, "predictions").join(one_row_per(anomaly, KEY, "anomalies"), KEY)
    df = _with_alerts(both, alert_rows)
    ml3 = F.col("ml_prediction") == 1
    odd = F.col("anomaly_flag") == 1
    high = F.col("anomaly_direction") == "HIGH"
    rule_high, rule_spike = F.col("np3_high") == 1, F.col("np3_spike") == 1
    return df.withColumns(
        {
            "agreement_category": _two_way(ml3, odd, "BOTH_ANOMALY", "ML3_ONLY", "ML4_ONLY"),
            "direction_category": F.when(ml3 & high, "BOTH_ML3_AND_ML4_HIGH")
            .when(ml3, "ML3_HIGH_ONLY")
            .when(high, "ML4_HIGH_ONLY")
            .when(F.col("anomaly_direction") == "LOW", "ML4_LOW")
            .otherwise("NEITHER_HIGH"),
            "high_comparison_group": _two_way(ml3, high, *HIGH_GROUPS),
            "ml_vs_rule_high": _two_way(
                ml3, rule_high, "BOTH_AGREE_HIGH_ACTIVITY", "ML_ONLY", "NP3_ONLY"
            ),
            "ml_vs_rule_spike": _two_way(
                ml3, rule_spike, "BOTH_AGREE_SPIKE", "ML_ONLY", "NP3_ONLY"
            ),
            "three_way_high_category": _three_way(ml3, high, rule_high),
            "three_way_spike_category": _three_way(ml3, high, rule_spike),
        }
    )


def anomaly_vs_rules(scored: DataFrame, alert_rows: DataFrame, span: DataFrame) -> DataFrame:
    """Anomalies against alerts inside the time span of another frame's ``timestamp``."""
    low, high = (span.agg(f("timestamp")).scalar() for f in (F.min, F.max))
    inside = scored.filter(F.col("timestamp").between(low, high)).select(
        *KEY, "total_activity", "deviation", "anomaly_direction"
    )
    df = _with_alerts(inside, alert_rows)
    up = F.col("anomaly_direction") == "HIGH"

    def against(flag):
        return _two_way(up, F.col(flag) == 1, "BOTH_AGREE", "ML4_ONLY", "NP3_ONLY")

    return df.withColumns(
        {"ml4_vs_np3_high": against("np3_high"), "ml4_vs_np3_spike": against("np3_spike")}
    )


def category_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and percentage per category of every given column, in one pass."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("comparison"), F.col(c).alias("category")) for c in columns]
    )
    whole = F.sum("n_rows").over(Window.partitionBy("comparison"))
    return (
        df.select(F.inline(pairs))
        .groupBy("comparison", "category")
        .agg(F.count("*").alias("n_rows"))
        .withColumn("percentage", F.col("n_rows") * 100.0 / whole)
    )


def detector_agreement(compared: DataFrame, flag: str = "np3_spike") -> DataFrame:
    """How often model and rule say the same."""
    ml, rule = F.col("ml_prediction") == 1, F.col(flag) == 1
    return compared.agg(
        F.count("*").alias("total_compared"),
        F.count_if(ml & rule).alias("both_agree"),
        F.count_if(ml & ~rule).alias("ml_only"),
        F.count_if(~ml & rule).alias("np3_only"),
        F.count_if(~ml & ~rule).alias("neither"),
    ).withColumn(
        "agreement_rate",
        (F.col("both_agree") + F.col("neither")) / F.col("total_compared"),
    )


def disagreement_profile(compared: DataFrame) -> DataFrame:
    """Median and mean of the analysis columns per group, rounded to 4 places."""
    group = "high_comparison_group"
    means = compared.groupBy(group).agg(*[F.avg(c).alias(c) for c in PROFILE_COLUMNS])
    long = means.select(
        group,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).alias("mean"))
                    for c in PROFILE_COLUMNS
                ]
            )
        ),
    )
    medians = exact_quantiles(compared, PROFILE_COLUMNS, [0.5], by=[group])
    return long.join(medians, [group, "column"], "left").select(
        group,
        "column",
        F.round("value", 4).alias("median_value"),
        F.round("mean", 4).alias("mean_value"),
    )


def disagreement_hours(compared: DataFrame) -> DataFrame:
    """Hour of day by group: the percentage of each group's rows in that hour."""
    counts = (
        compared.groupBy("hour_of_day").pivot("high_comparison_group", HIGH_GROUPS).count().na.fill(0)
    )
    every = Window.partitionBy(F.lit(1))  # 24 rows at most
    shares = []
    for g in HIGH_GROUPS:
        total = F.sum(g).over(every)
        shares.append(F.when(total > 0, F.col(g) * 100.0 / total).alias(g.lower()))
    return counts.select("hour_of_day", *shares)


def disagreement_examples(compared: DataFrame, n: int = 5) -> DataFrame:
    """The strongest few rows per three-way class, each class by its own detector's signal."""
    name = F.col("three_way_high_category")
    # The classes in the order they are shown.
    wanted = ["ALL_THREE", "ML3_ONLY", "ML4_ONLY", "NP3_ONLY", "ML3_ML4_ONLY", "ML4_NP3_ONLY"]
    signal = (
        F.when(name == "ML4_ONLY", F.col("deviation"))
        .when(name == "NP3_ONLY", F.col("np3_baseline_activity"))
        .otherwise(F.col("ml_prediction_probability"))
    )
    order = Window.partitionBy("three_way_high_category").orderBy(
        F.desc_nulls_last("signal"), "grid_id", "timestamp"
    )
    return (
        compared.filter(name.isin(wanted))
        .withColumn("signal", signal)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= n)
        .select("three_way_high_category", "place", "grid_id", "timestamp", "signal")
    )
