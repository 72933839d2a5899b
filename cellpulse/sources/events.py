"""Raw activity rows derived from the ``events`` table, one row per event."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.schemas import RAW_CHANNELS, RAW_COLUMNS

# Which event type feeds which channel.
CHANNEL_OF_EVENT = {
    "click": "smsin",
    "view": "smsout",
    "purchase": "callin",
    "signup": "callout",
    "error": "internet",
}
# About four cells per 150 users keeps 3 to 4 events in each cell-hour at every scale, so
# whole 48-hour runs and gaps both occur, and the number of cells grows with the table.
USERS_PER_CELL = 38
EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
)


def activity_from_events(events: DataFrame) -> DataFrame:
    """RAW rows (typed), sparse like the real feed: one channel per row, the others null.

    A few rows are spoiled on purpose by their ``event_id``: time missing, cell missing, value
    negative. Activity is counted in hundredths, so sums do not depend on the order of adding.
    """
    spoiled = F.col("event_id")
    units = F.round(F.col("value") * 100)
    signed = F.when(spoiled % 983 == 11, -units - 1).otherwise(units)
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp")
    channel = [
        F.when(F.col("event_type") == event, signed).alias(name)
        for event, name in CHANNEL_OF_EVENT.items()
    ]
    return events.select(
        F.when(spoiled % 997 != 5, hour).alias("datetime"),
        F.when(spoiled % 991 != 7, F.floor(F.col("user_id") / USERS_PER_CELL) + 1)
        .cast("int")
        .alias("CellID"),
        F.col("user_id").cast("int").alias("countrycode"),
        *channel,
        F.concat(
            F.lit("sms-call-internet-mi-"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv")
        ).alias("_source_file"),
    ).select(*RAW_COLUMNS, "_source_file")


def activity_text_from_events(events: DataFrame) -> DataFrame:
    """The all-string variant: a missing time is an unreadable text, blanks are null."""
    raw = activity_from_events(events)
    time_text = F.coalesce(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"), F.lit("not-a-time"))
    return raw.select(
        time_text.alias("datetime"),
        F.col("CellID").cast("string"),
        F.col("countrycode").cast("string"),
        *[F.col(c).cast("string") for c in RAW_CHANNELS],
        "_source_file",
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def raw_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_from_events(_events(spark, sf_dir))


def raw_activity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_text_from_events(_events(spark, sf_dir))
