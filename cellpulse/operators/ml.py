"""Next-hour risk models in Spark ML: split by time, weight, fit, tune, score, store."""

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
)
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.functions.columns import hours_between, percent_text, risk_band
from cellpulse.operators.metrics import ml_eval
from cellpulse.schemas import FORBIDDEN_FEATURES, LOG_FEATURES, MODEL_FEATURES, SIX_FEATURES
from cellpulse.session import materialise, scratch_dir

LABEL = "high_activity"
SEED = 42
# The version label of scores, and the (depth, smallest leaf) settings tried.
MODEL_VERSION = "ml3-decision-tree-v1"
TREE_GRID = [
    (3, 100),
    (4, 100),
    (5, 100),
    (6, 100),
    (7, 100),
    (5, 250),
    (5, 500),
    (6, 250),
    (6, 500),
]


def chrono_split(df: DataFrame, frac: float = 0.8, ts: str = "feature_timestamp") -> DataFrame:
    """Mark the earliest ``frac`` of the distinct hours as train and the rest as test.

    Only distinct hours are gathered, whose number is the length of the history.
    """
    hours = F.sort_array(F.collect_set(ts))
    last = F.get(hours, F.floor(F.size(hours) * frac).cast("int") - 1)  # null where none is left
    cutoff = df.agg(last).scalar()
    return df.withColumn("split", F.when(F.col(ts) <= cutoff, "train").otherwise("test"))


def split_report(df: DataFrame, ts: str = "feature_timestamp") -> DataFrame:
    return df.groupBy("split").agg(
        F.min(ts).alias("earliest"),
        F.max(ts).alias("latest"),
        F.count("*").alias("n_rows"),
        F.countDistinct(ts).alias("timestamps"),
        F.countDistinct("grid_id").alias("grids"),
    )


def split_checks(df: DataFrame, model_features=MODEL_FEATURES) -> DataFrame:
    """Train ends before test starts, targets lie one hour ahead, inputs are not derived from the
    target and have no nulls: one row."""
    train, t = F.col("split") == "train", F.col("feature_timestamp")
    forbidden = len([c for c in model_features if c in FORBIDDEN_FEATURES])
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in model_features])
    return df.agg(
        F.max(F.when(train, t)).alias("train_latest"),
        F.min(F.when(~train, t)).alias("test_earliest"),
        F.count_if(hours_between(F.col("target_timestamp"), t) != 1).alias("invalid_targets"),
        F.count_if(absent).alias("rows_with_nulls"),
        F.lit(forbidden).cast("long").alias("forbidden_features"),
    ).withColumn(
        "passed",
        (F.col("train_latest") < F.col("test_earliest"))
        & (F.col("invalid_targets") + F.col("rows_with_nulls") + F.col("forbidden_features") == 0),
    )


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weights n / (2 n_c) as a column."""
    counts = df.agg(
        F.struct(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    ).scalar()
    own = F.when(F.col(label) == 1, counts["p"]).otherwise(counts["n"] - counts["p"])
    return df.withColumn("weight", counts["n"] / (2 * own))


def prepare(training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train with weights, test). Stored first: the cut-off, the weights and the fits then read
    Parquet instead of computing the windows again."""
    marked = chrono_split(materialise(training, "training"))
    train = class_weights(marked.filter(F.col("split") == "train"))
    return materialise(train, "train"), marked.filter(F.col("split") == "test")


def _tree(depth, min_leaf, columns):
    return [
        VectorAssembler(inputCols=columns, outputCol="inputs"),
        DecisionTreeClassifier(
            featuresCol="inputs",
            labelCol=LABEL,
            weightCol="weight",
            maxDepth=depth,
            minInstancesPerNode=min_leaf,
            seed=SEED,
        ),
    ]


def fit_tree(train: DataFrame, depth=5, min_leaf=100, columns=MODEL_FEATURES) -> PipelineModel:
    return Pipeline(stages=_tree(depth, min_leaf, columns)).fit(train)


def fit_plain_tree(train: DataFrame, depth: int = 5) -> PipelineModel:
    """The unweighted tree over the six stored features."""
    stages = [
        VectorAssembler(inputCols=SIX_FEATURES, outputCol="inputs"),
        DecisionTreeClassifier(featuresCol="inputs", labelCol=LABEL, maxDepth=depth, seed=SEED),
    ]
    return Pipeline(stages=stages).fit(train)


def fit_lr(train: DataFrame, log1p: bool = True, columns=MODEL_FEATURES, reg: float = 0.0):
    """Standardised, balanced logistic regression; ``log1p`` compresses the skewed inputs."""
    skewed = [c for c in columns if log1p and c in LOG_FEATURES]
    logs = "".join(f", log1p({c}) AS log_{c}" for c in skewed)
    inputs = [f"log_{c}" if c in skewed else c for c in columns]
    stages = [
        SQLTransformer(statement=f"SELECT *{logs} FROM __THIS__"),
        VectorAssembler(inputCols=inputs, outputCol="raw_inputs"),
        StandardScaler(inputCol="raw_inputs", outputCol="inputs", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="inputs",
            labelCol=LABEL,
            weightCol="weight",
            maxIter=1000,
            regParam=reg,
            standardization=False,
        ),
    ]
    # A freshly fitted model carries a training summary that holds the session, which cannot be
    # sent to executors once that session has observed metrics. A stored model carries none.
    path = scratch_dir(train.sparkSession, "logistic")
    Pipeline(stages=stages).fit(train).write().save(path)
    return PipelineModel.load(path)


def fit_gbt(train: DataFrame, rounds=20, depth=6, columns=MODEL_FEATURES) -> PipelineModel:
    """Boosted trees; decide at 0.3 with ``metrics.at_threshold``."""
    stages = [
        VectorAssembler(inputCols=columns, outputCol="inputs"),
        GBTClassifier(
            featuresCol="inputs", labelCol=LABEL, maxIter=rounds, maxDepth=depth, stepSize=0.05,
            seed=SEED,
        ),
    ]
    return Pipeline(stages=stages).fit(train)


def predict(model: PipelineModel, df: DataFrame, suffix: str = "") -> DataFrame:
    """``df`` with 0/1 ``prediction`` and the positive-class ``probability``."""
    scored = model.transform(df)
    return scored.select(
        *[F.col(c) for c in df.columns],
        F.col("prediction").cast("int").alias(f"prediction{suffix}"),
        vector_to_array("probability")[1].alias(f"probability{suffix}"),
    )


def tune_tree(train: DataFrame, grid=TREE_GRID) -> DataFrame:
    """Validation metrics per (depth, leaf) on the later fifth of the training hours, best first.

    The loop is over settings; every fit and every metric runs on the cluster.
    """
    marked = materialise(chrono_split(train.drop("split", "weight")), "tune")
    fit = materialise(class_weights(marked.filter(F.col("split") == "train")), "tune-fit")
    validation = marked.filter(F.col("split") == "test")
    rows = []
    for depth, leaf in grid:
        scored = predict(fit_tree(fit, depth, leaf), validation)
        rows.append(
            ml_eval(scored).withColumns(
                {"max_depth": F.lit(depth), "min_samples_leaf": F.lit(leaf)}
            )
        )
    table = reduce(lambda a, b: a.unionByName(b), rows)
    return table.orderBy(
        F.desc("f1"), F.desc("average_precision"), "max_depth", "min_samples_leaf"
    )


def ml_importance(model: PipelineModel, spark, columns=MODEL_FEATURES) -> DataFrame:
    """Importance per input, its rank, and the share of the two strongest."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    ranked = sorted(zip(columns, values), key=lambda r: (-r[1], r[0]))
    top_two = sum(v for _, v in ranked[:2])
    rows = [(name, v, i + 1, top_two) for i, (name, v) in enumerate(ranked)]
    return spark.createDataFrame(
        rows, "feature string, importance double, place int, top_two_importance double"
    )


def lr_coefficients(model: PipelineModel, spark, columns=MODEL_FEATURES) -> DataFrame:
    """Coefficients of the standardised inputs by absolute size."""
    values = [float(v) for v in model.stages[-1].coefficients.toArray()]
    ranked = sorted(zip(columns, values), key=lambda r: (-abs(r[1]), r[0]))
    rows = [(name, v, abs(v), i + 1) for i, (name, v) in enumerate(ranked)]
    return spark.createDataFrame(
        rows, "feature string, coefficient double, absolute_coefficient double, place int"
    )


def risk_levels(scored: DataFrame, version: str = MODEL_VERSION) -> DataFrame:
    """Probability of high activity in the next hour as a graded risk record."""
    p = F.col("probability")
    return scored.select(
        "grid_id",
        "feature_timestamp",
        p.alias("risk_score"),
        risk_band(p).alias("risk_level"),
        F.lit(version).alias("model_version"),
        F.concat(
            F.lit("Predicted high-activity risk is "),
            percent_text(p),
            F.lit("% for the next hour; an operational indicator, not confirmed congestion."),
        ).alias("explanation_note"),
    )


def risk_scores(model: PipelineModel, feature_rows: DataFrame) -> DataFrame:
    return risk_levels(predict(model, feature_rows))


def ml_predictions(models: dict[str, PipelineModel], test: DataFrame) -> DataFrame:
    """Class and probability of every model beside each test row, without a join."""
    keep = [
        "grid_id",
        "feature_timestamp",
        "target_timestamp",
        "target_activity",
        "trailing_median_24h",
        LABEL,
    ]
    out, added = test, []
    for name, model in models.items():
        out = predict(model, out, suffix=f"_{name}")
        added += [f"prediction_{name}", f"probability_{name}"]
    return out.select(*keep, *added)


def ml_roundtrip(model: PipelineModel, path: str, test: DataFrame) -> DataFrame:
    """Store, load and score again: how many rows score differently."""
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    both = predict(again, predict(model, test, "_before"), "_after")
    return both.agg(
        F.count("*").alias("rows_scored"),
        F.count_if(
            (F.col("probability_before") != F.col("probability_after"))
            | (F.col("prediction_before") != F.col("prediction_after"))
        ).alias("rows_different"),
    )
