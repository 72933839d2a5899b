"""Star schema: two dimensions, one fact table, loads that can be repeated."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.columns import weekday_sunday_zero
from cellpulse.operators.geo import ring_mean
from cellpulse.schemas import MAX_CELL, MEASURES, MIN_CELL
from cellpulse.sources.tables import new_rows


def time_rows(hourly: DataFrame) -> DataFrame:
    """Distinct hours with their calendar parts (weekday 0 = Sunday), without a key."""
    ts = F.col("timestamp")
    return (
        hourly.select(F.date_trunc("hour", "timestamp").alias("timestamp"))
        .distinct()
        .select(
            "timestamp",
            F.to_date(ts).alias("date_value"),
            F.hour(ts).alias("hour_of_day"),
            weekday_sunday_zero(ts).alias("day_of_week"),
        )
    )


def grid_rows(lookup: DataFrame, file_name: str) -> DataFrame:
    """Cells with centroid and a reference into the geometry file, without a key."""
    shape = F.col("shape")
    return lookup.select(
        "grid_id",
        ring_mean(shape, 1).alias("centroid_latitude"),
        ring_mean(shape, 0).alias("centroid_longitude"),
        F.concat(F.lit(f"{file_name}#"), F.col("grid_id").cast("string")).alias("geometry_ref"),
    )


def dim_upsert(
    existing: DataFrame | None, incoming: DataFrame, natural_key: str, key: str
) -> DataFrame:
    """Insert or update by natural key. Stored surrogate keys stay; new rows get the next ones.

    Numbering needs one ordered group of the new members, and of those alone. That is fine for these dimensions,
    whose length is the number of cells of the map or of hours of the history.
    """
    if existing is None:
        order = Window.partitionBy(F.lit(1)).orderBy(natural_key)
        return incoming.select(
            F.row_number().over(order).cast("long").alias(key), *incoming.columns
        )
    columns = [c for c in incoming.columns if c != natural_key]
    new = incoming.select(natural_key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    pick = [F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    stored = existing.join(new, natural_key, "left").select(F.col(key).cast("long").alias(key), natural_key, *pick)
    last = F.coalesce(existing.agg(F.max(key)).scalar(), F.lit(0))
    order = Window.partitionBy(F.lit(1)).orderBy(natural_key)
    fresh = incoming.join(existing.select(natural_key), natural_key, "left_anti").select(
        (last + F.row_number().over(order)).cast("long").alias(key), natural_key, *columns
    )
    return stored.unionByName(fresh)


def dim_time(hourly: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    return dim_upsert(existing, time_rows(hourly), "timestamp", "time_key")


def dim_grid(lookup: DataFrame, file_name: str, existing: DataFrame | None = None) -> DataFrame:
    return dim_upsert(existing, grid_rows(lookup, file_name), "grid_id", "grid_key")


def fact_build(hourly: DataFrame, grids: DataFrame, times: DataFrame, dated: bool = False) -> DataFrame:
    """Hourly rows with the two surrogate keys; missing measures become 0.

    ``dated`` adds ``date_value``, by which a stored fact table has its folders.
    """
    keyed = hourly.join(grids.select("grid_id", "grid_key"), "grid_id").join(
        times.select("timestamp", "time_key", "date_value"), "timestamp"
    )
    measures = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in MEASURES]
    return keyed.select("grid_key", "time_key", *measures, *(["date_value"] if dated else []))


def fact_load(existing: DataFrame, fact: DataFrame) -> DataFrame:
    """The rows still to be appended: a repeated load of the same days adds nothing.

    Of a dated fact table only the folders from the first to the last day of ``fact`` are read: the two
    days are sub-queries of the scan, so ``fact`` should be stored.
    """
    if "date_value" not in existing.columns or "date_value" not in fact.columns:
        return new_rows(existing, fact, ["grid_key", "time_key"])
    first, last = (fact.agg(bound("date_value")).scalar() for bound in (F.min, F.max))
    near = existing.filter(F.col("date_value").between(first, last))
    return new_rows(near, fact, ["date_value", "grid_key", "time_key"])


def dimension_coverage(hourly: DataFrame, grids: DataFrame, times: DataFrame) -> DataFrame:
    """Hourly rows that find their cell and their hour. Rows are counted per key first."""
    per_cell = hourly.groupBy("grid_id").agg(F.count("*").alias("n"))
    per_hour = hourly.groupBy("timestamp").agg(F.count("*").alias("n"))
    in_time = per_hour.join(times, "timestamp", "left_semi").agg(F.sum("n")).scalar()
    in_grid = per_cell.join(grids, "grid_id", "left_semi").agg(F.sum("n")).scalar()
    return per_cell.agg(F.sum("n").alias("hourly_rows")).withColumns(
        {
            "rows_in_dim_grid": F.coalesce(in_grid, F.lit(0)),
            "rows_in_dim_time": F.coalesce(in_time, F.lit(0)),
        }
    )


def star_history(fact: DataFrame, grids: DataFrame, times: DataFrame) -> DataFrame:
    """Fact rows with cell and hour in place of the keys."""
    return (
        fact.join(grids.select("grid_key", "grid_id"), "grid_key")
        .join(times.select("time_key", "timestamp", "date_value", "hour_of_day"), "time_key")
        .select("grid_id", "timestamp", "date_value", "hour_of_day", *MEASURES)
    )


def warehouse_checks(
    grids: DataFrame, times: DataFrame, fact: DataFrame, expected_cells=MAX_CELL
) -> DataFrame:
    """Counts and violations of the loaded tables, one row.

    ``expected_cells``: a number, or a scalar column such as the length of a look-up.
    """
    null_measure = F.lit(False)
    for c in MEASURES:
        null_measure = null_measure | F.col(c).isNull()
    # Each table is read once, added up per key first.
    per_fact = fact.groupBy("grid_key", "time_key").agg(
        F.count("*").alias("n"), F.count_if(null_measure).alias("null_rows")
    )
    per_cell = grids.groupBy("grid_id").agg(F.count("*").alias("n"))
    cells = per_cell.agg(
        F.struct(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(
                F.sum(F.when(~F.col("grid_id").between(MIN_CELL, MAX_CELL), F.col("n"))), F.lit(0)
            ).alias("outside"),
            F.count_if(F.col("n") > 1).alias("repeated"),
        )
    ).scalar()
    return (
        per_fact.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("fact_rows"),
            F.coalesce(F.sum("null_rows"), F.lit(0)).alias("null_measure_rows"),
            F.count_if(F.col("n") > 1).alias("repeated_facts"),
        )
        .withColumn("_cells", cells)
        .select(
            "fact_rows",
            "null_measure_rows",
            F.col("_cells.rows").alias("grid_rows"),
            times.agg(F.count("*")).scalar().alias("time_rows"),
            F.col("_cells.outside").alias("cells_out_of_range"),
            F.col("_cells.repeated").alias("repeated_grids"),
            "repeated_facts",
        )
        .withColumn(
            "passed",
            (F.col("fact_rows") > 0)
            & (F.col("grid_rows") == expected_cells)
            & (
                F.col("null_measure_rows")
                + F.col("cells_out_of_range")
                + F.col("repeated_grids")
                + F.col("repeated_facts")
                == 0
            ),
        )
    )
