"""Jump consistent hashing: a stable shard for every key without a ring table.

The shard of a key depends on the key and the number of shards alone. Going from n to n + 1 shards
moves one key in n + 1, and only into the new shard (Lamping and Veach, 2014).

Edge cases: a null key counts as one key of its own, a null text has no bytes; repeated rows share a
shard and get slots of their own; an empty table gives no rows; further columns pass through
``shard_rows`` and those named like its results are replaced.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Fixed value: multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
#: Cells in which the rows of a shard are numbered; their counts are all that is ever gathered.
CELLS = 1024


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key. Keys jump ahead together until each next jump leaves the range."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        at[moving] = ahead[moving]
        key[moving] = key[moving] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = ((key[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[moving] = ((at[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return at


def shard_of(key, shards: int):
    """Column with the shard of a key column of any type."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf(IntegerType())
    def place(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(np.int64), shards).astype(np.int32))

    return place(F.xxhash64(key))


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """All rows with ``shard`` and ``grown_shard``, the shard when one more is appended."""
    return docs.withColumns({"shard": shard_of(F.col(key), shards), "grown_shard": shard_of(F.col(key), shards + 1)})


def slots(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Adds ``slot``: a gapless number from 0 within each shard.

    A shard is numbered in ``CELLS`` parts: the parts are counted, their counts added up, and rows
    ranked inside their part only, so no task holds a shard. ``order`` must settle all but equal rows;
    columns named like the temporary ones (``_cell``, ``_rank``, ``_before``) are refused.
    """
    if clash := {"_cell", "_rank", "_before"} & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} would be lost")
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(CELLS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * CELLS rows. Rows are dealt by shard and cell to be ranked, and meet them there.
    offsets = (
        rows.groupBy("shard", "_cell")
        .count()
        .select("shard", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("shard", "_cell").orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "_cell"])
        .withColumn("slot", (F.col("_before") + F.col("_rank")).cast("long"))
        .drop("_cell", "_rank", "_before")
    )


def shard_index(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    data = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    # Rows without an id, or of one id, are told apart by their texts: cells and order are the same in every run.
    return slots(shard_rows(slim, shards), ["doc_id", "text_crc32", "size"], shards).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
