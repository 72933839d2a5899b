"""Table sources and sinks by format and options (parquet, jdbc, ...)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, fmt: str, **options) -> DataFrame:
    """A whole table. For JDBC pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` so that the scan is not one task; joins are left to Spark."""
    return spark.read.format(fmt).options(**options).load()


def append_table(df: DataFrame, fmt: str, by=(), **options) -> None:
    """Append, to one folder per value of ``by`` where given. JDBC batches have 5000 rows by default; ``numPartitions`` (connections) is the caller's."""
    settings = {"batchsize": 5000} if fmt == "jdbc" else {}
    df.write.format(fmt).options(**{**settings, **options}).partitionBy(*by).mode("append").save()


def overwrite_table(df: DataFrame, fmt: str, **options) -> None:
    """Replace the rows and, where the format can, keep the table definition."""
    settings = {"truncate": True} if fmt == "jdbc" else {}
    df.write.format(fmt).options(**{**settings, **options}).mode("overwrite").save()


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet: appending them twice changes nothing."""
    return incoming.join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows win over stored rows with the same natural key."""
    kept = existing.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming)


def dedupe(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first by ``order``. Combined map-side, so copies of a key that fill
    a third of the table never meet in one task. ``order`` are ascending columns."""
    ranked = F.struct(*[F.col(c) for c in order])
    payload = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*payload), ranked).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)
