"""Bounded window groups for long histories."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.columns import epoch_hours

BLOCK_HOURS = 24 * 28


def with_halo(df: DataFrame, ts="timestamp", before=0, after=0, block_hours=BLOCK_HOURS):
    """Cut each cell's history into time blocks that overlap by the reach of a window frame.

    A row is copied into every block that needs it: its own, the next one when it lies within
    ``before`` hours of that block's start, the previous one when it lies within ``after`` hours
    of that block's end. Windows partitioned by (cell, ``_block``) then hold at most
    ``block_hours + before + after`` hours, so one cell with a long history spreads over many
    tasks. ``own_rows`` removes the copies afterwards. Only for frames bounded in time.
    """
    hour = epoch_hours(F.col(ts))
    first = F.floor((hour - after) / block_hours)
    last = F.floor((hour + before) / block_hours)
    return df.withColumn("_own", F.floor(hour / block_hours)).withColumn(
        "_block", F.explode(F.sequence(first, last))
    )


def with_row_halo(df: DataFrame, ts="timestamp", before=0, block_rows=BLOCK_HOURS, block_hours=BLOCK_HOURS):
    """Like ``with_halo`` for frames that reach back ``before`` rows, whatever the gaps between them.

    Rows are numbered per cell without putting a cell's rows in one group: they are counted per time
    block, the counts added up over a cell's blocks, and rows numbered inside their time block only. Blocks
    of ``block_rows`` numbers then overlap by the last ``before`` of them.
    """
    blocked = df.withColumn("_time", F.floor(epoch_hours(F.col(ts)) / block_hours))
    earlier = Window.partitionBy("grid_id").orderBy("_time").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocked.groupBy("grid_id", "_time").count()
    offsets = counts.select("grid_id", "_time", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("grid_id", "_time").orderBy(ts)
    numbered = blocked.withColumn("_place", F.row_number().over(inside) - 1).join(offsets, ["grid_id", "_time"])
    row = F.col("_offset") + F.col("_place")
    return (
        numbered.withColumn("_own", F.floor(row / block_rows))
        .withColumn("_block", F.explode(F.sequence(F.col("_own"), F.floor((row + before) / block_rows))))
        .drop("_time", "_offset", "_place")
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_block") == F.col("_own")).drop("_block", "_own")
