"""Keep the feature, alert, anomaly and risk tables of a stored hourly table up to date, day by day.

A run handles the days that came after those of the run before. What it needs of the past is stored:
sorted values per (cell, hour of day) for the growing medians, the last row of each cell, the totals of each
cell and day for the activity floor, the fitted model. Of the hourly table it reads the new days and the
two days before them.

State is kept per run, in folders named by the last day they know of, and a run is on record only when all
its tables are written: a run that died is done again. ``since`` does days over, after corrected data:
it goes on from the newest state that ends before that day.
"""

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.operators import alerts, anomaly, compare, features, metrics, ml
from cellpulse.session import exists, remove
from cellpulse.sources import files

BY_DAY = ("features", "alerts", "anomalies", "risk_scores", "compared", "daily_totals")
#: Days before a batch that features of its first hour reach back to.
REACH = dt.timedelta(days=2)


def _by_day(df: DataFrame, path: str, ts: str) -> None:
    files.write_partitioned(df.withColumn("date", F.to_date(ts)), path)


def _last_run(spark: SparkSession, output: str, since: dt.date | None) -> dt.date | None:
    """Last day of the newest run to go on from. State of runs that ``since`` makes stale goes."""
    if not exists(spark, f"{output}/runs"):
        return None
    # One row per run.
    ends = {r[0] for r in spark.read.parquet(f"{output}/runs").select("through").distinct().collect()}
    stale = {end for end in ends if since and end >= since}
    kept = [end for end in ends - stale if exists(spark, f"{output}/state/cells/through={end}")]
    last = max(kept, default=None)
    for end in stale:
        remove(spark, f"{output}/state/buckets/through={end}")
        remove(spark, f"{output}/state/cells/through={end}")
    if stale:
        # Days without rows this time would keep the rows of last time.
        days = [] if last is None else [last + dt.timedelta(days=k + 1) for k in range((max(stale) - last).days)]
        for name in BY_DAY:
            for folder in [f"{output}/{name}/date={day}" for day in days] or [f"{output}/{name}"]:
                remove(spark, folder)
    return last


def detect(
    spark: SparkSession, hourly_path: str, output: str, severity=None, since: dt.date | None = None, refit: bool = False
) -> dict:
    """Features, alerts, anomalies and risk scores of the days not handled yet, and where they agree.

    The first run, and any with ``refit``, fits the risk tree on all labelled hours and evaluates it on the
    last fifth of them; other runs score with the stored one. An alert stands as it was judged on its day:
    the floor is that of all days known then. Returns the folders.
    """
    hourly = spark.read.parquet(hourly_path)
    paths = {name: f"{output}/{name}" for name in (*BY_DAY, "evaluation", "model")}
    last = _last_run(spark, output, since)
    new = hourly if last is None else hourly.filter(F.col("date") > F.lit(last))
    first_day, last_day = new.agg(F.min("date"), F.max("date")).first()
    if first_day is None:
        return paths
    near = hourly.filter((F.col("date") >= F.lit(first_day - REACH)) & (F.col("date") <= F.lit(last_day)))

    def of_batch(df, ts):
        return df.filter(F.to_date(ts) >= F.lit(first_day))

    _by_day(of_batch(features.feature_table(near), "feature_timestamp"), paths["features"], "feature_timestamp")
    _alerts_and_anomalies(spark, new, output, paths, last, last_day, severity)

    fit = refit or not exists(spark, paths["model"])
    if fit:
        train, judged = ml.prepare(features.training_table(hourly))
        model = ml.fit_tree(train)
        model.write().overwrite().save(paths["model"])
        files.write_parquet(metrics.ml_eval(ml.predict(model, judged)), paths["evaluation"])
    else:
        model = PipelineModel.load(paths["model"])
        judged = of_batch(features.training_table(near), "target_timestamp")
    stored = spark.read.parquet(paths["features"])
    to_score = stored if fit else stored.filter(F.col("date") >= F.lit(first_day))
    _by_day(ml.risk_scores(model, to_score), paths["risk_scores"], "feature_timestamp")
    _by_day(_compared(spark, ml.predict(model, judged), paths, None if fit else first_day), paths["compared"], "timestamp")

    record = spark.range(1).select(F.lit(first_day).alias("first_day"), F.lit(last_day).alias("through"))
    record.write.mode("append").parquet(f"{output}/runs")
    return paths


def _alerts_and_anomalies(spark, new, output, paths, last, last_day, severity) -> None:
    """Alerts and anomalies of the batch, from the state of the run before, and the state after it."""
    files.write_partitioned(alerts.daily_totals(new), paths["daily_totals"])
    totals = spark.read.parquet(paths["daily_totals"]).filter(F.col("date") <= F.lit(last_day))
    if last is None:
        before, scored, buckets = None, anomaly.anomalies(new), anomaly.order_state(new)
        cells = alerts.last_hours(new)
    else:
        before = spark.read.parquet(f"{output}/state/cells/through={last}")
        state = spark.read.parquet(f"{output}/state/buckets/through={last}")
        scored, buckets = anomaly.anomalies_increment(state, new), anomaly.merge_state(state, new)
        cells = alerts.last_hours(before.unionByName(new.select(*before.columns)))
    _by_day(alerts.alerts(new, severity=severity, before=before, totals=totals), paths["alerts"], "timestamp")
    _by_day(scored, paths["anomalies"], "timestamp")
    files.write_parquet(buckets, f"{output}/state/buckets/through={last_day}")
    files.write_parquet(cells, f"{output}/state/cells/through={last_day}")


def _compared(spark, scored: DataFrame, paths: dict, first_day: dt.date | None) -> DataFrame:
    predictions = scored.select(
        "grid_id",
        F.col("target_timestamp").alias("timestamp"),
        "peak_ratio",
        "activity_growth",
        "trailing_median_24h",
        "target_activity",
        F.col("prediction").alias("ml_prediction"),
        F.col("probability").alias("ml_prediction_probability"),
    )

    def stored(name):
        df = spark.read.parquet(paths[name])
        return (df if first_day is None else df.filter(F.col("date") >= F.lit(first_day))).drop("date")

    return compare.detector_compare(predictions, stored("anomalies"), stored("alerts"))
