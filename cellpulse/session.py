"""Session set-up and the shared scratch folder."""

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app="cellpulse", master=None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Rows of a day land in day folders, so a re-run replaces only its own days.
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def size_shuffles(spark: SparkSession, input_bytes: int, per_partition: int = 128 << 20) -> None:
    """Enough shuffle partitions for an input of this size, so that each fits in memory.

    Adaptive execution merges partitions that turn out small, but it does not split those of an
    aggregation that turn out big. So the number is set from above and never below the current.
    """
    wanted = -(-input_bytes // per_partition)
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", str(max(current, wanted)))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one the cluster names.

    On a cluster that names none this is an error: executors would each write to their own disk. Only
    a local session, as in tests, gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^-].*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cellpulse-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write once to shared storage and read back: cuts the lineage and survives executor loss.

    For frames that an iterative fit reads many times. ``options`` go to the Parquet writer.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("errorifexists").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever store its path names."""
    store, place = _store(spark, path)
    store.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


@contextlib.contextmanager
def scratch_table(df: DataFrame, name: str, by=()):
    """``materialise`` for readers that are done when the block ends; the table goes then.

    ``by``: columns, moved to the end, with a folder for each of their values.
    """
    path = scratch_dir(df.sparkSession, name)
    df.select(*[c for c in df.columns if c not in by], *by).write.mode("errorifexists").partitionBy(*by).parquet(path)
    try:
        stored = df.select(*[c for c in df.columns if c not in by], *by).schema
        yield df.sparkSession.read.schema(stored).parquet(path)
    finally:
        remove(df.sparkSession, path)
