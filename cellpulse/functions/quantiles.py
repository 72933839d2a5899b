"""Exact quantiles whose reducers stay small however many rows there are."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _beside(df: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the facts of their group: one row of facts per group, or one in all."""
    names = [c for c in facts.columns if c not in by]
    if not by:
        one = facts.select(F.struct(*names)).scalar()
        return df.withColumn("_facts", one).select(df["*"], *[F.col(f"_facts.{c}").alias(c) for c in names])
    own = facts.select(*[F.col(c).alias(f"_{c}") for c in by], *names)
    met = df.join(F.broadcast(own), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return met.drop(*[f"_{c}" for c in by])


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    by: list[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Linear-interpolated quantiles: one row per (``by``, column, q) with ``value``.

    ``percentile`` would gather every distinct value of a group in one task. Here a mergeable
    sketch first brackets each quantile between two values. One more pass takes all columns of a row as
    they stand: per quantile it counts the rows below the bracket and keeps the nearest value on either
    side, and rows are told apart only by the few values that lie inside some bracket (about 4/accuracy of
    the rows). Those are then put in order. The sketch error is at most 1/accuracy of the rows, the
    bracket is twice as wide, so the wanted ranks are inside it or next to it; should one not be, the
    query fails.

    ``by`` holds category columns with a fixed short list of values, which bounds the brackets
    that are broadcast to (categories x columns x probabilities) values.
    """
    by = list(by)
    slack = 2.0 / accuracy
    slim = df.select(*by, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    probes = []
    for q in probabilities:
        probes += [max(q - slack, 0.0), min(q + slack, 1.0)]
    sketch = slim.groupBy(*by).agg(
        *[F.percentile_approx(f"_x{i}", probes, accuracy).alias(f"_p{i}") for i in range(len(columns))]
    )

    hits, sums, again, pieces = [], [F.count("*").alias("_k")], [], []
    for i in range(len(columns)):
        x = F.col(f"_x{i}")
        sums.append(F.count(x).alias(f"_n{i}"))
        again.append(F.sum(f"_n{i}").alias(f"_n{i}"))
        for j, q in enumerate(probabilities):
            cell = i * len(probabilities) + j
            below = x < F.col(f"_p{i}")[2 * j] if q > slack else F.lit(False)
            above = x > F.col(f"_p{i}")[2 * j + 1] if q < 1 - slack else F.lit(False)
            hits.append(F.when(x.isNotNull() & ~below & ~above, F.struct(F.lit(cell).alias("cell"), x.alias("x"))))
            sums += [
                F.count_if(below & x.isNotNull()).alias(f"_below{cell}"),
                F.max(F.when(below, x)).alias(f"_most{cell}"),
                F.min(F.when(above, x)).alias(f"_least{cell}"),
            ]
            again += [
                F.sum(f"_below{cell}").alias(f"_below{cell}"),
                F.max(f"_most{cell}").alias(f"_most{cell}"),
                F.min(f"_least{cell}").alias(f"_least{cell}"),
            ]
            position = F.when(F.col(f"_n{i}") > 0, F.lit(float(q)) * (F.col(f"_n{i}") - 1))
            for side, k, value in ((-1, F.col(f"_below{cell}"), f"_most{cell}"), (1, F.lit(1).cast("long"), f"_least{cell}")):
                pieces.append(
                    F.struct(
                        F.lit(cell).alias("cell"),
                        F.lit(side).alias("side"),
                        F.col(value).alias("x"),
                        k.alias("k"),
                        position.alias("position"),
                    )
                )
    told_apart = _beside(slim, sketch, by).withColumn("_hits", F.array_compact(F.array(*hits)))
    counted = told_apart.groupBy(*by, "_hits").agg(*sums)

    outside = counted.groupBy(*by).agg(*again).select(*by, F.inline(F.array(*pieces))).filter(F.col("position").isNotNull())
    inside = (
        counted.select(*by, "_k", F.inline("_hits"))
        .groupBy(*by, "cell", "x")
        .agg(F.sum("_k").alias("k"))
        .select(*by, "cell", F.lit(0).alias("side"), "x", "k", F.lit(None).cast("double").alias("position"))
    )
    keys = by + ["cell"]
    order = Window.partitionBy(*keys).orderBy("side", "x")
    ranked = outside.unionByName(inside).withColumns(
        {"upto": F.sum("k").over(order), "position": F.max("position").over(Window.partitionBy(*keys))}
    )

    def value_at(rank):
        """The value of a rank from 0: any inside, the last below, the first above."""
        first, last = F.col("upto") - F.col("k"), F.col("upto") - 1
        known = (
            F.when((F.col("side") == 0) & rank.between(first, last), F.col("x"))
            .when((F.col("side") < 0) & (rank == last), F.col("x"))
            .when((F.col("side") > 0) & (rank == first), F.col("x"))
        )
        return F.max(known)

    low, high = F.floor("position"), F.ceil("position")
    found = ranked.groupBy(*keys).agg(
        value_at(low).alias("a"), value_at(high).alias("b"), F.max("position").alias("position")
    )
    missed = F.col("a").isNull() | F.col("b").isNull()
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("position") - F.floor("position"))
    names = F.array(*[F.lit(c) for c in columns for _ in probabilities])
    wanted = F.array(*[F.lit(float(q)) for _ in columns for q in probabilities])
    return found.select(
        *by,
        names[F.col("cell")].alias("column"),
        wanted[F.col("cell")].alias("q"),
        F.when(missed, F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"))
        .otherwise(value)
        .alias("value"),
    )


def quantile_scalar(df: DataFrame, column: str, q: float):
    """One exact quantile as a scalar sub-query column, null for an empty frame."""
    return exact_quantiles(df, [column], [q]).select("value").scalar()
