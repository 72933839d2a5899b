"""Look-ups on token files as ``wavelet.write_shards`` stores them: access, counting and occurrences.

Places are those of the whole corpus: tokens of all documents end to end, in the files' order. Every
function is one scan of the shards; inside a shard, a look-up opens one compressed block per plane and
place, not the sequence. Where a shard starts is a running sum over sizes, per part and then over parts.

Edge cases: places beyond the corpus, null places and tokens that do not occur have no row, or a count of 0;
repeated places or tokens are looked up once; no shards give no rows and counts of 0.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.llm.wavelet import BITS, SHARDS, WaveletMatrix


def open_shards(spark, path: str) -> DataFrame:
    """start (tokens of all shards before), n_ids and planes of every shard."""
    shards = spark.read.schema(SHARDS).parquet(path)
    ahead = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = shards.select("part", "number", F.col("n_ids").alias("n"))
    # One row per part (some 32 MB of text), so one task can put them in order.
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).withColumn("_of_part", ahead(Window.orderBy("part")))
    inside = sizes.withColumn("_inside", ahead(Window.partitionBy("part").orderBy("number")))
    starts = inside.join(parts.drop("n"), "part").select("part", "number", (F.col("_of_part") + F.col("_inside")).alias("start"))
    return shards.select("part", "number", "n_ids", "planes").join(starts, ["part", "number"]).select("start", "n_ids", "planes")


def _ids(values) -> list[int]:
    found = sorted(set(values))
    if any(not 0 <= v < 1 << BITS for v in found):
        raise ValueError(f"tokens lie between 0 and {(1 << BITS) - 1}")
    return found


def count_of(spark, path: str, tokens) -> DataFrame:
    """token, n: how often each token of a list occurs."""
    asked = _ids(tokens)

    def work(batches):
        for batch in batches:
            for planes in batch.column(0).to_pylist():
                matrix = WaveletMatrix.from_bytes(planes)
                counts = [matrix.count(t) if matrix.size else 0 for t in asked]
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array(counts, pa.int64())], names=["token", "n"])

    found = open_shards(spark, path).select("planes").mapInArrow(work, "token int, n long")
    every = spark.createDataFrame([(t, 0) for t in asked], "token int, n long")
    return found.unionByName(every).groupBy("token").agg(F.sum("n").alias("n"))


def places_of(spark, path: str, tokens) -> DataFrame:
    """token, place: every occurrence of each token of a list."""
    asked = _ids(tokens)

    def work(batches):
        for batch in batches:
            for start, planes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matrix = WaveletMatrix.from_bytes(planes)
                for token in asked:
                    count = matrix.count(token) if matrix.size else 0
                    for lo in range(0, count, 10_000):
                        places = [start + matrix.select(token, k) for k in range(lo, min(lo + 10_000, count))]
                        arrays = [pa.array([token] * len(places), pa.int32()), pa.array(places, pa.int64())]
                        yield pa.RecordBatch.from_arrays(arrays, names=["token", "place"])

    return open_shards(spark, path).select("start", "planes").mapInArrow(work, "token int, place long")


def tokens_at(spark, path: str, places: DataFrame, place: str = "place") -> DataFrame:
    """place, token of every place of a table, of any length: places meet the shards by stretches of the corpus."""
    shards = open_shards(spark, path)
    wide = 1 << 21
    ends = F.col("start") + F.col("n_ids")
    stretches = F.sequence(F.floor(F.col("start") / wide), F.floor((ends - 1) / wide))
    # Only numbers are joined to places; the planes come last, once per shard.
    shape = shards.filter("n_ids > 0").select("start", ends.alias("end"), F.explode(stretches).alias("stretch"))
    asked = places.select(F.col(place).cast("long").alias("place")).filter("place >= 0").distinct()
    met = asked.withColumn("stretch", F.floor(F.col("place") / wide)).join(shape, "stretch")
    met = met.filter((F.col("place") >= F.col("start")) & (F.col("place") < F.col("end")))
    per_shard = met.groupBy("start").agg(F.collect_list("place").alias("places"))  # no more than a shard has tokens

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix.from_bytes(row["planes"])
                found = np.array([matrix.access(p - row["start"]) for p in row["places"]], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row["places"], pa.int64()), pa.array(found)], names=["place", "token"])

    return shards.join(per_shard, "start").select("start", "places", "planes").mapInArrow(work, "place long, token int")
