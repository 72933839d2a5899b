"""The derived tables the registered queries start from, built lazily from one data folder."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.operators import alerts, anomaly, clean, features, rollup, star
from cellpulse.schemas import RAW_COLUMNS
from cellpulse.sources import events, gate, geojson

GEO_FILE = "cells.geojson"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        return events.raw_activity(self.spark, self.sf_dir)

    @cached_property
    def raw_text(self) -> DataFrame:
        return events.raw_activity_text(self.spark, self.sf_dir)

    @cached_property
    def clean(self) -> DataFrame:
        return clean.clean(self.raw)

    @cached_property
    def hourly(self) -> DataFrame:
        return rollup.hourly_summary(self.clean)

    @cached_property
    def headers(self) -> DataFrame:
        """Header names per daily file; the files of every tenth day lack one column."""
        short = F.array(*[F.lit(c) for c in RAW_COLUMNS[:-1]])
        full = F.array(*[F.lit(c) for c in RAW_COLUMNS])
        lacking = F.col("filename").rlike("7[.]csv$")
        return (
            self.raw_text.select(F.col("_source_file").alias("filename"))
            .distinct()
            .withColumn("header", F.when(lacking, short).otherwise(full))
        )

    @cached_property
    def gate(self) -> DataFrame:
        return gate.ingest_gate(self.raw_text, self.headers)

    @cached_property
    def documents(self) -> DataFrame:
        """GeoJSON documents for the cells that occur in the events."""
        cells = self.raw.select(F.col("CellID").alias("grid_id")).distinct()
        return geojson.square_documents(cells.filter(F.col("grid_id").isNotNull()))

    @cached_property
    def lookup(self) -> DataFrame:
        return geojson.cell_lookup(self.documents)

    @cached_property
    def some_lookup(self) -> DataFrame:
        """A lookup that does not know every third cell."""
        return self.lookup.filter(F.col("grid_id") % 3 != 0)

    @cached_property
    def dim_time(self) -> DataFrame:
        return star.dim_time(self.hourly)

    @cached_property
    def dim_grid(self) -> DataFrame:
        return star.dim_grid(self.lookup, GEO_FILE)

    @cached_property
    def fact(self) -> DataFrame:
        return star.fact_build(self.hourly, self.dim_grid, self.dim_time)

    @cached_property
    def features(self) -> DataFrame:
        return features.features(self.hourly)

    @cached_property
    def labels(self) -> DataFrame:
        return features.next_hour_label(self.hourly)

    @cached_property
    def medians(self) -> DataFrame:
        return features.trailing_median(self.hourly)

    @cached_property
    def training(self) -> DataFrame:
        return features.training_table(self.hourly)

    @cached_property
    def alerts(self) -> DataFrame:
        """Alerts graded by the caller: high activity is HIGH, the other two MEDIUM."""
        grade = F.when(F.col("alert_type") == "HIGH_ACTIVITY", "HIGH").otherwise("MEDIUM")
        return alerts.alerts(self.hourly, severity=grade)

    @cached_property
    def anomalies(self) -> DataFrame:
        return anomaly.anomalies(self.hourly)

    @cached_property
    def scored_training(self) -> DataFrame:
        """A stand-in score with a SQL equivalent, where a fitted model would have none."""
        score = F.round(F.least(F.col("peak_ratio") / 6, F.lit(1.0)), 6)
        return self.training.withColumn("probability", score).withColumn(
            "prediction", (score >= 0.5).cast("int")
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """The stand-in predictions at the hour they are about."""
        return self.scored_training.select(
            "grid_id",
            F.col("target_timestamp").alias("timestamp"),
            "peak_ratio",
            "activity_growth",
            "trailing_median_24h",
            "target_activity",
            F.col("prediction").alias("ml_prediction"),
            F.col("probability").alias("ml_prediction_probability"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """One question per cell and day: what was known at half past one in the afternoon."""
        noonish = F.date_trunc("day", "timestamp") + F.make_dt_interval(
            hours=F.lit(13), mins=F.lit(30)
        )
        return self.hourly.select("grid_id", noonish.alias("as_of")).distinct()

    @cached_property
    def day_pairs(self) -> DataFrame:
        """Each cell's days beside the same weekday one week later."""
        days = self.hourly.select("grid_id", F.col("date").alias("date_a")).distinct()
        return days.withColumn("date_b", F.date_add("date_a", 7))

    @cached_property
    def grid_pairs(self) -> DataFrame:
        cells = self.hourly.select(F.col("grid_id").alias("grid_a")).distinct()
        return cells.withColumn("grid_b", F.col("grid_a") + 1)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison: engines add up means and deviations in different orders."""
    return df.select(
        *[
            F.round(F.col(name), digits).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        ]
    )
