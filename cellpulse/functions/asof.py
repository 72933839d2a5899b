"""As-of join: for each request the newest row at or before its time."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.columns import epoch_hours
from cellpulse.functions.timeblocks import BLOCK_HOURS


def as_of_join(
    history: DataFrame,
    requests: DataFrame,
    ts: str,
    key: str = "grid_id",
    as_of: str = "as_of",
    block_hours: int = BLOCK_HOURS,
) -> DataFrame:
    """Requests (key, as_of) with the columns of the newest history row, null where there is none.

    History and distinct requests are merged in time order inside (key, time block) groups, so no
    request meets more than one block of history and a key with very many requests spreads over
    its blocks. Each group then is one row: its requests with what they found there, and its last row. Those
    last rows are carried forward over the blocks of a key to the requests that found nothing in their own.
    The history is read once and shuffled once.
    """
    payload = [c for c in history.columns if c != key]
    kind = history.select(F.struct(*payload)).schema[0].dataType

    def block(c):
        return F.floor(epoch_hours(c) / block_hours)

    facts = history.select(
        key,
        block(F.col(ts)).alias("_block"),
        F.col(ts).alias("_t"),
        F.lit(1).alias("_kind"),
        F.struct(*payload).alias("_row"),
    )
    asked = requests.select(key, F.col(as_of).alias("_t")).distinct()
    asked = asked.select(
        key,
        block(F.col("_t")).alias("_block"),
        "_t",
        F.lit(2).alias("_kind"),
        F.lit(None).cast(kind).alias("_row"),
    )
    merged = facts.unionByName(asked)
    order = (
        Window.partitionBy(key, "_block")
        .orderBy(F.col("_t").asc_nulls_first(), "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = merged.withColumn("_row", F.last("_row", ignorenulls=True).over(order))
    is_request = F.col("_kind") == 2
    blocks = found.groupBy(key, "_block").agg(
        F.collect_list(F.when(is_request, F.struct(F.col("_t").alias(as_of), "_row"))).alias("_asked"),
        F.max_by("_row", F.struct("_t", "_kind")).alias("_last"),
    )
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier))
    answered = carried.select(key, "_carried", F.inline("_asked"))
    row = F.coalesce("_row", "_carried")
    return answered.select(key, as_of, *[row[c].alias(c) for c in payload])
