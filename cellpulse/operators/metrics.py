"""Binary classification metrics as plain aggregations over a prediction table.

A prediction table has a 0/1 ``label``, a 0/1 ``prediction`` and a ``probability``.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCORE_BUCKETS = 256
THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(17)]
DEFAULT_LABEL = "high_activity"


def _ratio(num, den):
    return F.when(den > 0, num / den).otherwise(0.0)


def _positive_class(tp, fp, fn, tn) -> dict:
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "precision": precision,
        "recall": recall,
        "f1": _ratio(2 * precision * recall, precision + recall),
    }


def confusion_matrix(pred: DataFrame, label: str = DEFAULT_LABEL) -> DataFrame:
    return pred.groupBy(label, "prediction").agg(F.count("*").alias("n_rows"))


def predicted_classes(pred: DataFrame) -> DataFrame:
    return pred.groupBy("prediction").agg(F.count("*").alias("n_rows"))


def _counts(pred: DataFrame, label: str, predicted=None) -> DataFrame:
    actual = F.col(label) == 1
    said = F.col("prediction") == 1 if predicted is None else predicted
    return pred.agg(
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
        F.count_if(~actual & ~said).alias("tn"),
    )


def class_metrics(pred: DataFrame, label: str = DEFAULT_LABEL) -> DataFrame:
    """Metrics of the positive class and the class-weighted precision and recall, one row."""
    return _with_class_metrics(_counts(pred, label))


def _with_class_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    weighted_precision = _ratio(
        (tp + fn) * _ratio(tp, tp + fp) + (tn + fp) * _ratio(tn, tn + fn), n
    )
    weighted_recall = _ratio(
        (tp + fn) * _ratio(tp, tp + fn) + (tn + fp) * _ratio(tn, tn + fp), n
    )
    return counts.withColumns(
        {
            **_positive_class(tp, fp, fn, tn),
            "weighted_precision": weighted_precision,
            "weighted_recall": weighted_recall,
        }
    )


def _range_of(bounds, score):
    """How many of the sorted ``bounds`` are below ``score``, by binary search."""
    steps = [F.lit(SCORE_BUCKETS >> k) for k in range(1, SCORE_BUCKETS.bit_length())]
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda found, step: found + F.when(F.get(bounds, found + step - 1) < score, step).otherwise(0),
    )


def _ranked(by_score: DataFrame, by: list[str]) -> DataFrame:
    """ROC-AUC (ties count half) and average precision per ``by``, from rows per score.

    Both need, for every score, how many rows score at least as high. Running sums are taken inside
    256 score ranges of about equal length per group, and what the ranges above contribute comes from one
    small table of range totals, so that no task has to order all scores. ``by`` holds a short list of
    values, such as the scores of the models compared: 256 ranges of each are broadcast.
    """
    cuts = [i / SCORE_BUCKETS for i in range(1, SCORE_BUCKETS)]

    def beside(df, other):
        """Joined with a short table on the groups (and ranges) that both have."""
        keys = [c for c in (*by, "range") if c in df.columns and c in other.columns]
        own = other.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in other.columns])
        met = df.join(F.broadcast(own), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
        return met.drop(*[f"_{c}" for c in keys])

    bounds = by_score.groupBy(*by).agg(F.percentile_approx("score", cuts, 10_000).alias("_bounds"))
    ranged = beside(by_score, bounds).withColumn("range", _range_of(F.col("_bounds"), F.col("score"))).drop("_bounds")
    above = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    offsets = totals.select(
        *by,
        "range",
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p_above"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"),
    )
    inside = Window.partitionBy(*by, "range").orderBy(F.desc("score"))
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranged.withColumns({"p_in": F.sum("pos").over(inside), "n_in": F.sum("neg").over(inside)})
    counted = beside(running, offsets)
    tp, fp = F.col("p_above") + F.col("p_in"), F.col("n_above") + F.col("n_in")
    sums = counted.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("pos") * (fp - F.col("neg") / 2)).alias("passed_over"),
        F.sum(F.col("pos") * tp / (tp + fp)).alias("precision_sum"),
    )
    pairs = F.col("positives") * F.col("negatives")
    return sums.select(
        *by,
        "positives",
        "negatives",
        F.when(pairs > 0, 1 - F.col("passed_over") / pairs).alias("roc_auc"),
        F.when(F.col("positives") > 0, F.col("precision_sum") / F.col("positives")).alias(
            "average_precision"
        ),
    )


def _rows_per_score(pred: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Equal scores added up, which is combined before it is shuffled."""
    return pred.groupBy(*by, F.col("probability").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )


def ranking_metrics(pred: DataFrame, label: str = DEFAULT_LABEL) -> DataFrame:
    """positives, negatives, ROC-AUC and average precision, one row; nulls for an empty table."""
    found = _ranked(_rows_per_score(pred.withColumn("_all", F.lit(1)), label, ["_all"]), ["_all"])
    return found.agg(*[F.max(c).alias(c) for c in found.columns if c != "_all"])


def ml_eval(pred: DataFrame, label: str = DEFAULT_LABEL) -> DataFrame:
    """Class and ranking metrics together, one row."""
    return compare_models(pred, {"only": ("prediction", "probability")}, label).drop("model")


def compare_models(pred: DataFrame, models: dict, label: str = DEFAULT_LABEL) -> DataFrame:
    """One row of metrics per model, all from one plan over one table.

    ``models``: name to (prediction, probability), columns or names of columns of ``pred``. Counts of all
    models are taken in one pass. Models whose probability is the same column share its ranks.
    """

    def column(c):
        return F.col(c) if isinstance(c, str) else c

    # The number of each distinct score.
    scores: dict[str, int] = {}
    for _, probability in models.values():
        scores.setdefault(str(column(probability)), len(scores))
    actual, counts, rows = F.col(label) == 1, [], []
    for k, (name, (prediction, probability)) in enumerate(models.items()):
        said = column(prediction).cast("int") == 1
        parts = {"tp": actual & said, "fp": ~actual & said, "fn": actual & ~said, "tn": ~actual & ~said}
        counts += [F.count_if(rule).alias(f"{part}_{k}") for part, rule in parts.items()]
        score = F.lit(scores[str(column(probability))]).alias("_score")
        rows.append(F.struct(F.lit(name).alias("model"), score, *[F.col(f"{part}_{k}").alias(part) for part in parts]))
    classes = _with_class_metrics(pred.agg(*counts).select(F.inline(F.array(*rows))))
    own = {scores[str(column(p))]: column(p).cast("double") for _, p in models.values()}
    pairs = [F.struct(F.lit(k).alias("_score"), c.alias("probability")) for k, c in own.items()]
    long = pred.select(label, F.inline(F.array(*pairs)))
    ranks = _ranked(_rows_per_score(long, label, ["_score"]), ["_score"]).drop("positives", "negatives")
    return classes.join(F.broadcast(ranks), "_score", "left").drop("_score")


def threshold_sweep(pred: DataFrame, label: str = DEFAULT_LABEL, thresholds=THRESHOLDS):
    """Metrics at each cut-off from one pass over the predictions; ``place`` 1 is the best.

    Best is the highest F1, then recall, then the lowest cut-off.
    """
    actual = F.col(label) == 1
    counts = [F.count("*").alias("n"), F.count_if(actual).alias("p")]
    for i, cut in enumerate(thresholds):
        said = F.col("probability") >= cut
        counts += [F.count_if(said & actual).alias(f"tp{i}"), F.count_if(said).alias(f"pp{i}")]
    rows = []
    for i, cut in enumerate(thresholds):
        tp, said = F.col(f"tp{i}"), F.col(f"pp{i}")
        fp, fn = said - tp, F.col("p") - tp
        parts = _positive_class(tp, fp, fn, F.col("n") - tp - fp - fn)
        rows.append(
            F.struct(F.lit(cut).alias("threshold"), *[v.alias(k) for k, v in parts.items()])
        )
    table = pred.agg(*counts).select(F.inline(F.array(*rows)))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("f1"), F.desc("recall"), "threshold")
    return table.withColumn("place", F.row_number().over(order))


def at_threshold(pred: DataFrame, threshold: float) -> DataFrame:
    """Predictions re-decided at another cut-off."""
    return pred.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))


def majority_baseline(test: DataFrame) -> DataFrame:
    """Predictions of a model that always says the frequent class, 0."""
    return test.withColumns({"prediction": F.lit(0), "probability": F.lit(0.0)})


def model_compare(predictions: dict[str, DataFrame], label: str = DEFAULT_LABEL) -> DataFrame:
    """One row of metrics per named prediction table. See ``compare_models`` for models of one table."""
    rows = [
        pred.select(F.lit(name).alias("model"), label, "prediction", F.col("probability").cast("double").alias("probability"))
        for name, pred in predictions.items()
    ]
    long = reduce(lambda a, b: a.unionByName(b), rows)
    actual, said = F.col(label) == 1, F.col("prediction") == 1
    counts = long.groupBy("model").agg(
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
        F.count_if(~actual & ~said).alias("tn"),
    )
    ranks = _ranked(_rows_per_score(long, label, ["model"]), ["model"]).drop("positives", "negatives")
    return _with_class_metrics(counts).join(F.broadcast(ranks), "model", "left")
