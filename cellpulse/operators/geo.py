"""Cell geometry beside activity. The activity side is never shuffled for a lookup that is small:
Spark broadcasts a lookup whose size it knows to be below the threshold, and merges otherwise."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.functions.columns import percent


def geo_enrich(hourly: DataFrame, lookup: DataFrame) -> DataFrame:
    """Row-preserving left join on the cell."""
    return hourly.join(lookup.select("grid_id", "geometry"), "grid_id", "left")


def _rows_per_cell(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("grid_id").agg(F.count("*").alias("n"))


def geo_coverage(hourly: DataFrame, lookup: DataFrame) -> DataFrame:
    """How many rows and cells have a geometry. Rows are counted per cell before the join."""
    known = lookup.select("grid_id", F.lit(True).alias("found"))
    found = F.col("found").isNotNull()
    return (
        _rows_per_cell(hourly)
        .join(known, "grid_id", "left")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum(F.when(found, F.col("n"))), F.lit(0)).alias("matched_rows"),
            F.count("*").alias("total_cells"),
            F.count_if(found).alias("matched_cells"),
        )
        .withColumn("coverage_pct", percent(F.col("matched_rows"), F.col("total_rows")))
    )


def unmatched_cells(hourly: DataFrame, lookup: DataFrame) -> DataFrame:
    return hourly.select("grid_id").distinct().join(lookup, "grid_id", "left_anti")


def geometry_types(lookup: DataFrame) -> DataFrame:
    return lookup.groupBy(F.get_json_object("geometry", "$.type").alias("geometry_type")).agg(
        F.count("*").alias("cells")
    )


def geo_validate(hourly: DataFrame, lookup: DataFrame) -> DataFrame:
    """Cells seen in the activity whose geometry is missing, blank or without a type."""
    cells = geo_enrich(hourly.select("grid_id").distinct(), lookup)
    text = F.col("geometry")
    blank = text.isNull() | (F.length(F.trim(text)) == 0)
    return cells.agg(
        F.count("*").alias("cells"),
        F.count_if(text.isNull()).alias("missing_geometry"),
        F.count_if(blank).alias("empty_geometry"),
        F.count_if(F.get_json_object(text, "$.type").isNull()).alias("invalid_geometry"),
    ).withColumn(
        "valid",
        F.col("missing_geometry") + F.col("empty_geometry") + F.col("invalid_geometry") == 0,
    )


def hotspots_geo(top: DataFrame, lookup: DataFrame) -> DataFrame:
    """Geometry for the few top cells, joined after the limit."""
    return geo_enrich(top, lookup)


def ring_mean(shape, axis: int):
    """Mean of the outer ring's vertices on one axis (0 longitude, 1 latitude).

    The closing vertex counts. Null unless the shape is a polygon with a ring.
    """
    ring = shape["coordinates"][0]
    total = F.aggregate(ring, F.lit(0.0), lambda acc, point: acc + point[axis])
    usable = (shape["type"] == "Polygon") & (F.size(ring) > 0)
    return F.when(usable, total / F.size(ring))
