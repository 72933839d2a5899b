"""Cell polygons from GeoJSON."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.schemas import GEOJSON_SCHEMA


def read_geojson(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Documents with a ``features`` array, read with a fixed schema."""
    return spark.read.schema(GEOJSON_SCHEMA).option("multiLine", multiline).json(path)


def cell_lookup(documents: DataFrame) -> DataFrame:
    """One row per cell: geometry as struct and as JSON text.

    The cell is ``properties.cellId``; the feature's own ``id`` counts from 0 and is only used to
    choose between repeated cells (the lowest wins). Features without a cell are dropped.
    """
    features = documents.select(F.inline("features")).select(
        F.col("properties.cellId").alias("grid_id"), F.col("id").alias("feature_id"), "geometry"
    )
    return (
        features.filter(F.col("grid_id").isNotNull())
        .groupBy("grid_id")
        .agg(F.min_by(F.struct("geometry"), "feature_id").alias("f"))
        .select(
            "grid_id",
            F.col("f.geometry").alias("shape"),
            F.to_json("f.geometry").alias("geometry"),
        )
    )


def square_documents(cells: DataFrame, per_document: int = 1000) -> DataFrame:
    """GeoJSON documents for the given cells: cell i is the unit square at (i mod 100, i div 100).

    For running on data that brings no polygons. Some features are odd on purpose: a point-like
    shape without coordinates, a feature without a cell, a second feature for a cell.
    """
    cell = F.col("grid_id")
    x = (cell % 100).cast("double")
    y = F.floor(cell / 100).cast("double")

    def ring(dx):
        left, right = x + dx, x + (1.0 + dx)
        corners = [(left, y), (right, y), (right, y + 1.0), (left, y + 1.0), (left, y)]
        return F.array(F.array(*[F.array(a, b) for a, b in corners]))

    def feature(feature_id, cell_id, shape, dx=0.0):
        return F.struct(
            F.lit("Feature").alias("type"),
            feature_id.cast("long").alias("id"),
            F.struct(cell_id.cast("int").alias("cellId")).alias("properties"),
            F.struct(
                shape.alias("type"),
                F.when(shape == "Polygon", ring(dx)).alias("coordinates"),
            ).alias("geometry"),
        )

    kind = F.when(cell % 11 == 2, "MultiPoint").otherwise("Polygon")
    polygon = F.lit("Polygon")
    features = F.array_compact(
        F.array(
            feature(cell - 1, cell, kind),
            F.when(cell % 4 == 1, feature(cell + 100_000, F.lit(None), polygon)),
            F.when(cell % 4 == 3, feature(cell + 200_000, cell, polygon, 0.5)),
        )
    )
    return (
        cells.select(F.floor(cell / per_document).alias("doc"), F.explode(features).alias("f"))
        .groupBy("doc")
        .agg(F.collect_list("f").alias("features"))
        .select(F.lit("FeatureCollection").alias("type"), "features")
    )


def write_geojson(documents: DataFrame, path: str) -> None:
    """One document per line."""
    documents.write.mode("errorifexists").json(path)
