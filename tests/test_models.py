"""Fits, scores and served questions on small made-up histories."""

import datetime as dt
import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from cellpulse.operators import compare, metrics, ml, serve
from cellpulse.schemas import MODEL_FEATURES
from cellpulse.session import materialise


@pytest.fixture(scope="module")
def training(spark):
    """500 hours of 4 cells in which a high peak ratio means a busy next hour."""
    rng = random.Random(11)
    rows = []
    for cell in range(1, 5):
        for i in range(500):
            t = at("2026-01-01") + dt.timedelta(hours=i)
            busy = rng.random() < 0.25
            rows.append(
                (cell, t, t + dt.timedelta(hours=1), int(busy), 10.0, 8.0)
                + (rng.uniform(5, 9), rng.uniform(-1, 1), 5.0 + rng.random() if busy else 2.0)
                + (rng.uniform(1, 3), rng.random(), rng.uniform(5, 9), t.hour, t.weekday())
            )
    schema = (
        "grid_id int, feature_timestamp timestamp, target_timestamp timestamp, high_activity int, "
        "target_activity double, spare double, avg_activity double, activity_growth double, "
        "peak_ratio double, variability double, internet_share double, "
        "trailing_median_24h double, hour_of_day int, day_of_week int"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def fitted(training):
    train, test = ml.prepare(training)
    return train, test, ml.fit_tree(train, depth=3, min_leaf=20)


def test_split_is_by_time(training):
    marked = ml.chrono_split(training)
    report = {r.split: r for r in ml.split_report(marked).collect()}
    assert report["train"].timestamps == 400 and report["test"].timestamps == 100
    assert report["train"].latest < report["test"].earliest
    assert ml.split_checks(marked).first().passed


def test_forbidden_inputs_are_noticed(training):
    marked = ml.chrono_split(training)
    row = ml.split_checks(marked, MODEL_FEATURES + ["target_activity"]).first()
    assert row.forbidden_features == 1 and not row.passed


def test_weights_balance_the_classes(fitted):
    train = fitted[0]
    sums = train.groupBy("high_activity").agg(F.sum("weight").alias("w")).collect()
    assert sums[0].w == pytest.approx(sums[1].w) == pytest.approx(train.count() / 2)


def test_tree_finds_the_signal(spark, fitted):
    train, test, model = fitted
    row = metrics.ml_eval(ml.predict(model, test)).first()
    assert row.f1 == row.roc_auc == row.average_precision == 1.0
    top = ml.ml_importance(model, spark).orderBy("place").first()
    assert top.feature == "peak_ratio" and top.top_two_importance == pytest.approx(1.0)
    levels = {r.risk_level for r in ml.risk_scores(model, test).collect()}
    assert levels == {"LOW", "CRITICAL"}


def test_linear_model_and_table_of_both(spark, fitted):
    train, test, tree = fitted
    linear = ml.fit_lr(train, reg=0.01)
    assert ml.lr_coefficients(linear, spark).orderBy("place").first().feature == "peak_ratio"
    both = ml.ml_predictions({"logistic": linear, "tree": tree}, test)
    assert both.count() == test.count()
    assert both.filter("prediction_logistic != prediction_tree").count() == 0


def test_full_results_of_the_fits(spark, sf_dir):
    """Coefficients, importances, grid and predictions as registered: what must hold of any fit."""
    from cellpulse.plans.queries import REGISTRY

    found = {name: REGISTRY[f"ml_{name}_table"](spark, sf_dir).collect() for name in ("lr_coefficients", "importance", "tune")}
    for rows, size in ((found["lr_coefficients"], "absolute_coefficient"), (found["importance"], "importance")):
        assert sorted(r.feature for r in rows) == sorted(MODEL_FEATURES)
        in_order = sorted(rows, key=lambda r: r.place)
        assert [r.place for r in in_order] == list(range(1, len(rows) + 1))
        assert all(a[size] >= b[size] for a, b in zip(in_order, in_order[1:]))
    importances = sorted((r.importance for r in found["importance"]), reverse=True)
    assert sum(importances) == pytest.approx(1, abs=1e-5)
    assert found["importance"][0].top_two_importance == pytest.approx(sum(importances[:2]), abs=1e-5)
    assert {(r.max_depth, r.min_samples_leaf) for r in found["tune"]} == set(ml.TREE_GRID)
    for r in found["tune"]:
        assert 0 <= r.f1 <= 1 and 0 <= r.average_precision <= 1
        if r.precision + r.recall > 0:
            assert r.f1 == pytest.approx(2 * r.precision * r.recall / (r.precision + r.recall), abs=1e-5)
    predicted = REGISTRY["ml_predictions_table"](spark, sf_dir)
    for name in ("logistic", "tree"):
        said, p = F.col(f"prediction_{name}"), F.col(f"probability_{name}")
        assert predicted.filter(~p.between(0, 1) | (said != (p > 0.5).cast("int")) & (F.abs(p - 0.5) > 1e-6)).isEmpty()


def test_tuning_is_sorted_by_f1(fitted):
    table = ml.tune_tree(fitted[0], [(1, 10), (2, 10)]).collect()
    assert len(table) == 2 and table[0].f1 >= table[1].f1


def test_stored_model_scores_the_same(fitted, tmp_path):
    _, test, model = fitted
    row = ml.ml_roundtrip(model, str(tmp_path / "model"), test).first()
    assert row.rows_scored == test.count() and row.rows_different == 0


def test_majority_and_other_cutoffs(fitted):
    scored = ml.predict(fitted[2], fitted[1])
    table = {
        r.model: r
        for r in metrics.model_compare(
            {"majority": metrics.majority_baseline(fitted[1]), "tree": scored}
        ).collect()
    }
    assert table["majority"].f1 == 0 and table["tree"].f1 == 1
    assert table["majority"].accuracy < 1
    best = metrics.threshold_sweep(scored).filter("place = 1").first()
    assert best.f1 == 1.0
    assert metrics.at_threshold(scored, 2.0).filter("prediction = 1").count() == 0


def test_three_way_names(spark):
    flags = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    df = spark.createDataFrame(flags, "a int, b int, c int")
    named = df.withColumn(
        "name", compare._three_way(F.col("a") == 1, F.col("b") == 1, F.col("c") == 1)
    )
    assert {(r.a, r.b, r.c): r.name for r in named.collect()} == {
        (0, 0, 0): "NONE",
        (1, 0, 0): "ML3_ONLY",
        (0, 1, 0): "ML4_ONLY",
        (0, 0, 1): "NP3_ONLY",
        (1, 1, 0): "ML3_ML4_ONLY",
        (1, 0, 1): "ML3_NP3_ONLY",
        (0, 1, 1): "ML4_NP3_ONLY",
        (1, 1, 1): "ALL_THREE",
    }


def test_feed_checks_its_arguments(spark):
    rows = [
        (1, at("2026-01-01 01:00"), "HIGH_ACTIVITY", 5.0, 2.0, "r", "HIGH"),
        (1, at("2026-01-01 02:00"), "ACTIVITY_DROP", 1.0, None, "r", "MEDIUM"),
        (1, at("2026-01-01 02:00"), "ACTIVITY_SPIKE", 1.0, 2.0, "r", "MEDIUM"),
    ]
    feed = spark.createDataFrame(
        rows,
        "grid_id int, timestamp timestamp, alert_type string, current_activity double, "
        "baseline_activity double, reason string, severity string",
    )
    with pytest.raises(ValueError):
        serve.alerts_feed(feed, severity="low")
    with pytest.raises(ValueError):
        serve.grid_activity(feed, cells=[0])
    for serve_some in (serve.alerts_feed, serve.alert_hotspots):
        with pytest.raises(ValueError):
            serve_some(feed, limit=0)
    assert serve.alerts_feed(feed, severity="high").first().alert_type == "HIGH_ACTIVITY"
    newest = serve.alert_hotspots(feed).collect()
    assert [r.alert_type for r in newest] == ["ACTIVITY_DROP", "ACTIVITY_SPIKE"]
    row = serve.alert_status_map(feed).first()
    assert row.status == "HIGH" and row.alert_types == "ACTIVITY_DROP, ACTIVITY_SPIKE, HIGH_ACTIVITY"


def test_hotspots_are_not_cut(spark):
    feed = spark.range(2500).selectExpr(
        "CAST(id AS INT) AS grid_id", "TIMESTAMP '2026-01-01 00:00:00' AS timestamp", "'HIGH_ACTIVITY' AS alert_type",
        "CAST(id AS DOUBLE) AS current_activity", "1.0D AS baseline_activity", "'r' AS reason", "'HIGH' AS severity",
    )
    assert serve.alert_hotspots(feed, limit=2500).count() == 2500


def test_comparison_of_totals(spark):
    t = at("2026-01-01 03:00")
    rows = [(1, t, 0.0, 0.0, 0.0, 0.0), (2, t, 3.0, 1.0, 6.0, 10.0), (3, t, 3.0, 2.0, 6.0, 11.0)]
    hourly = spark.createDataFrame(
        rows,
        "grid_id int, timestamp timestamp, total_sms double, total_calls double, "
        "internet_activity double, total_activity double",
    )
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "grid_a int, grid_b int")
    got = {r.grid_a: r for r in serve.compare_grids(hourly, pairs).collect()}
    assert got[1].difference_pct == 100.0 and got[2].difference_pct == pytest.approx(10.0)
    assert got[1].higher == "B" and got[2].peak_hour_a == 3
    kinds = serve.composition(hourly).filter("grid_id = 1").count()
    assert kinds == 0


def test_detection_day_by_day(spark, sf_dir, tmp_path):
    """All tables of the detection plan: a first run, a run on new days, one on none, one that does days over."""
    from cellpulse.operators import alerts, anomaly, features
    from cellpulse.plans import detection
    from cellpulse.plans.tables import Tables
    from cellpulse.sources import files

    source, out = str(tmp_path / "hourly"), str(tmp_path / "out")
    whole = materialise(Tables(spark, sf_dir).hourly, "hourly")
    cut = "2024-01-22"
    files.write_partitioned(whole.filter(F.col("date") < cut), source)

    def read(name):
        return spark.read.parquet(f"{out}/{name}")

    def same(got, expected):
        columns = expected.columns
        got, expected = (df.select(*columns) for df in (got, expected))
        assert got.count() == expected.count() and got.exceptAll(expected).isEmpty()

    detection.detect(spark, source, out)
    same(read("alerts"), alerts.alerts(whole.filter(F.col("date") < cut)))
    assert {"tp", "roc_auc"} <= set(read("evaluation").columns)
    tested = read("compared").count()
    assert tested > 0

    files.write_partitioned(whole.filter(F.col("date") >= cut), source)
    for _ in range(2):  # the second of these finds no new day
        detection.detect(spark, source, out)
        assert read("runs").count() == 2
        same(read("features"), features.feature_table(whole))
        same(read("anomalies"), anomaly.anomalies(whole))
        same(read("alerts").filter(F.col("date") >= cut), alerts.alerts(whole).filter(F.col("timestamp") >= cut))
        assert read("risk_scores").count() == read("features").count()
        late = features.training_table(whole).filter(F.col("target_timestamp") >= cut).count()
        assert read("compared").filter(F.col("date") >= cut).count() == late
    state = anomaly.order_state(whole)
    last = read("runs").agg(F.max("through")).first()[0]
    same(read(f"state/buckets/through={last}"), state)
    same(read(f"state/cells/through={last}"), alerts.last_hours(whole))

    corrected = whole.withColumn(
        "total_activity", F.when(F.col("date") >= "2024-01-25", F.lit(5.0)).otherwise(F.col("total_activity"))
    )
    files.write_partitioned(corrected, source)
    detection.detect(spark, source, out, since=dt.date(2024, 1, 25))
    same(read("anomalies"), anomaly.anomalies(corrected))
    same(read("features"), features.feature_table(corrected))
    same(read("alerts").filter(F.col("date") >= cut), alerts.alerts(corrected).filter(F.col("timestamp") >= cut))
