"""Load the star schema so that a repeated run changes nothing."""

from pyspark.sql import DataFrame, SparkSession

from cellpulse.operators import star
from cellpulse.session import exists, scratch_table
from cellpulse.sources.tables import append_table, overwrite_table, read_table


def _stored(spark: SparkSession, fmt: str, options: dict, first: bool) -> DataFrame | None:
    """The table, or None before its first load.

    A table in a folder is there if the folder is. Of other formats only the caller knows, because each
    database says in its own words that a table is missing.
    """
    if first or "path" in options and not exists(spark, options["path"]):
        return None
    return read_table(spark, fmt, **options)


def load_dimension(spark, name, build, fmt: str, options: dict, first: bool = False) -> DataFrame:
    """Upsert a dimension: merge, store aside, then replace the table with the stored rows."""
    with scratch_table(build(_stored(spark, fmt, options, first)), name) as merged:
        overwrite_table(merged, fmt, **options)
    return read_table(spark, fmt, **options)


def load_warehouse(
    spark: SparkSession, hourly: DataFrame, lookup: DataFrame, geo_file: str, tables: dict,
    fmt: str = "parquet", first: bool = False,
) -> dict:
    """``tables`` maps dim_time, dim_grid and fact_network_activity to their source options.

    ``first`` says that the tables do not exist yet, which is found out by itself for those in folders.
    A fact table in a folder has a folder per day inside, and a load looks at the days of its batch only.
    The facts of the batch are stored before, and so are those to append, so that they do not depend on the
    table they are written to.
    """
    times = load_dimension(
        spark, "dim-time", lambda old: star.dim_time(hourly, old), fmt, tables["dim_time"], first
    )
    grids = load_dimension(
        spark, "dim-grid", lambda old: star.dim_grid(lookup, geo_file, old), fmt, tables["dim_grid"], first
    )
    where = tables["fact_network_activity"]
    by = ["date_value"] if "path" in where else []
    with scratch_table(star.fact_build(hourly, grids, times, dated=bool(by)), "fact") as fact:
        existing = _stored(spark, fmt, where, first)
        if existing is None:
            append_table(fact, fmt, by, **where)
        else:
            with scratch_table(star.fact_load(existing, fact), "new-facts") as fresh:
                append_table(fresh, fmt, by, **where)
    return {
        "dim_time": times,
        "dim_grid": grids,
        "fact_network_activity": read_table(spark, fmt, **where),
    }
