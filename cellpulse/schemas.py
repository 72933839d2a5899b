"""Column names and explicit table schemas. Nothing is inferred from CSV."""

from pyspark.sql import types as T

# Source column names and the canonical names they become.
RENAMES = {
    "datetime": "timestamp",
    "CellID": "grid_id",
    "countrycode": "country_code",
    "smsin": "sms_in",
    "smsout": "sms_out",
    "callin": "call_in",
    "callout": "call_out",
    "internet": "internet_activity",
}
RAW_COLUMNS = list(RENAMES)
RAW_CHANNELS = RAW_COLUMNS[3:]
CHANNELS = [RENAMES[c] for c in RAW_CHANNELS]
TOTALS = ["total_sms", "total_calls", "total_activity"]
MEASURES = CHANNELS + TOTALS
FILE_PATTERN = "sms-call-internet-mi-*.csv"

MIN_CELL, MAX_CELL = 1, 10_000

# The stored features, the inputs of the models, and those that are compressed.
SIX_FEATURES = [
    "avg_activity",
    "activity_growth",
    "active_hours",
    "peak_ratio",
    "variability",
    "internet_share",
]
# Inputs of the next-hour risk model.
MODEL_FEATURES = [
    "avg_activity",
    "activity_growth",
    "peak_ratio",
    "variability",
    "internet_share",
    "trailing_median_24h",
    "hour_of_day",
    "day_of_week",
]
# Non-negative, right-skewed inputs that the linear model sees through log1p.
LOG_FEATURES = ["avg_activity", "peak_ratio", "variability", "trailing_median_24h"]
FORBIDDEN_FEATURES = ["target_activity", "target_timestamp", "high_activity"]

# Alert types and severities.
ALERT_TYPES = ["HIGH_ACTIVITY", "ACTIVITY_SPIKE", "ACTIVITY_DROP"]
SEVERITIES = ["HIGH", "MEDIUM"]


def _struct(**columns):
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_D, _I, _L, _S, _TS = (
    T.DoubleType(),
    T.IntegerType(),
    T.LongType(),
    T.StringType(),
    T.TimestampType(),
)

RAW_SCHEMA = _struct(
    datetime=_TS,
    CellID=_I,
    countrycode=_I,
    smsin=_D,
    smsout=_D,
    callin=_D,
    callout=_D,
    internet=_D,
)
RAW_TEXT_SCHEMA = T.StructType([T.StructField(c, _S) for c in RAW_COLUMNS])

HOURLY_SCHEMA = _struct(
    timestamp=_TS,
    grid_id=_I,
    **{c: _D for c in MEASURES},
    internet_share=_D,
    date=T.DateType(),
)
ALERT_SCHEMA = _struct(
    grid_id=_I,
    timestamp=_TS,
    alert_type=_S,
    current_activity=_D,
    baseline_activity=_D,
    reason=_S,
)

GEOJSON_SCHEMA = T.StructType(
    [
        T.StructField("type", _S),
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", _S),
                        T.StructField("id", _L),
                        T.StructField("properties", _struct(cellId=_I)),
                        T.StructField(
                            "geometry",
                            T.StructType(
                                [
                                    T.StructField("type", _S),
                                    T.StructField(
                                        "coordinates", T.ArrayType(T.ArrayType(T.ArrayType(_D)))
                                    ),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)
