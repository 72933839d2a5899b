"""Keys that must be unique, checked where rows of one key meet anyway."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_row_per(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """The same rows; a query over them fails when a key occurs twice.

    Rows are dealt and sorted by the keys, which a sort-merge join or a grouping on them then uses: the
    check costs no exchange of its own.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    told = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])
    fault = F.raise_error(F.concat(F.lit(f"{what}: more than one row with "), told)).cast("boolean")
    return df.withColumn("_number", number).filter(F.when(F.col("_number") == 1, F.lit(True)).otherwise(fault)).drop("_number")
