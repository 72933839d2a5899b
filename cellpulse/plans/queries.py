"""One registered query per operator. Each runs over the whole tables."""

from pyspark.sql import functions as F

from cellpulse.operators import alerts as rules
from cellpulse.operators import anomaly, checks, compare, geo, metrics, ml, rollup, serve, star
from cellpulse.operators import clean as cleaning
from cellpulse.operators import features as trailing
from cellpulse.plans.tables import GEO_FILE, Tables, rounded
from cellpulse.schemas import MODEL_FEATURES, RAW_CHANNELS
from cellpulse.session import materialise, scratch_dir
from cellpulse.sources import files, gate, geojson, tables

REGISTRY = {}


def query(fn):
    """Register ``fn(tables)`` under its own name as ``fn(spark, sf_dir)``."""
    REGISTRY[fn.__name__] = lambda spark, sf_dir: rounded(fn(Tables(spark, sf_dir)))
    return fn


# --- cleaning and profiling ---------------------------------------------------------------


@query
def clean(t):
    return t.clean.drop("_source_file")


@query
def rejected(t):
    return cleaning.rejected(t.raw).drop("_source_file")


@query
def null_profile(t):
    return cleaning.null_profile(t.raw, RAW_CHANNELS)


@query
def row_balance(t):
    return cleaning.row_balance(t.raw, t.clean, cleaning.rejected(t.raw))


@query
def time_parts(t):
    return cleaning.time_parts(t.hourly.select("timestamp").distinct())


@query
def profile(t):
    return rollup.profile(t.raw)


@query
def multi_country(t):
    return rollup.multi_country(t.clean)


@query
def country_freq(t):
    return rollup.country_freq(cleaning.canonicalise(t.raw))


@query
def grain_check(t):
    return rollup.grain_check(t.raw, ["datetime", "CellID", "countrycode"])


# --- roll-ups -----------------------------------------------------------------------------


@query
def hourly_summary(t):
    return t.hourly


@query
def daily_summary(t):
    return rollup.daily_summary(t.hourly)


@query
def daily_share(t):
    return rollup.daily_share(t.hourly)


@query
def daily_network(t):
    return rollup.daily_network(t.hourly)


@query
def grid_summary(t):
    return rollup.grid_summary(t.hourly)


@query
def dashboard_hourly(t):
    return rollup.dashboard_hourly(t.hourly)


@query
def dashboard_hourly_channels(t):
    return rollup.dashboard_hourly(t.hourly, split_channels=True)


@query
def kpis(t):
    return rollup.kpis(t.raw, t.clean, t.hourly)


@query
def peak_hour(t):
    return rollup.peak_hour(t.hourly)


@query
def peak_per_grid(t):
    return rollup.peak_per_grid(t.hourly)


@query
def overall_peak(t):
    return rollup.overall_peak(t.hourly)


@query
def hotspots(t):
    return rollup.hotspots(t.hourly)


@query
def hotspots_window(t):
    return rollup.hotspots(t.hourly, "2024-01-08", "2024-01-14", n=3)


@query
def hotspot_rank(t):
    return rollup.hotspot_rank(t.hourly)


# --- files, gate, sinks -------------------------------------------------------------------

NOW = "2024-01-31 06:00:00"


def _named_by_day(scan):
    """The daily file's name in place of the path of the part that Spark wrote."""
    name = F.regexp_extract("_source_file", r"_source_file=([^/]*)/", 1)
    return scan.select("*", name.alias("source_file")).drop("_source_file")


@query
def csv_scan(t):
    pattern = files.write_daily_csv(t.raw, scratch_dir(t.spark, "daily-csv"))
    return _named_by_day(files.read_raw(t.spark, pattern))


@query
def csv_scan_text(t):
    pattern = files.write_daily_csv(t.raw_text, scratch_dir(t.spark, "daily-text"))
    return _named_by_day(files.read_raw(t.spark, pattern, text=True))


@query
def ingest_gate(t):
    return t.gate


@query
def ingest_gate_extras(t):
    return gate.source_grain_checks(t.raw_text)


@query
def ingest_route(t):
    # The verdicts are stored first: Spark then knows their size when it plans the join.
    accepted, refused = gate.ingest_route(t.raw_text, materialise(t.gate, "gate"))
    return (
        accepted.withColumn("zone", F.lit("raw"))
        .unionByName(refused.withColumn("zone", F.lit("rejected")))
        .withColumnRenamed("_source_file", "source_file")
    )


@query
def ingest_ledger(t):
    path = scratch_dir(t.spark, "ledger")
    gate.append_ledger(t.gate, NOW, path)
    return t.spark.read.parquet(path)


@query
def run_status(t):
    status = gate.run_status(t.gate, t.hourly, NOW)
    return status.withColumn("reasons", F.array_join("reasons", " "))


@query
def run_status_record(t):
    """The record of a run whose load failed, its nested parts side by side."""
    tasks = {"spark_process": "SUCCESS", "load_warehouse": "FAILED", "publish": "SKIPPED"}
    record = gate.status_record(t.gate, t.hourly, NOW, "run-1", tasks, nulls_handled=7)
    states = F.transform(F.map_entries("tasks"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return record.select(
        *[c for c in record.columns if c not in ("tasks", "freshness", "reasons")],
        F.array_join(F.array_sort(states), ",").alias("tasks"),
        "freshness.latest_data_timestamp",
        "freshness.age_hours",
        "freshness.indicator",
        F.array_join("reasons", " ").alias("reasons"),
    )


@query
def sink_roundtrip(t):
    hourly, path = materialise(t.hourly, "hourly"), scratch_dir(t.spark, "hourly")
    files.write_partitioned(hourly, path)
    return files.readback_checks(hourly, path)


@query
def dedupe(t):
    keys = ["timestamp", "grid_id", "country_code"]
    kept = t.clean.select(*keys, "total_activity", "total_sms", "total_calls")
    return tables.dedupe(kept, keys, ["total_activity", "total_sms", "total_calls"])


# --- geometry -----------------------------------------------------------------------------


@query
def geo_lookup(t):
    path = scratch_dir(t.spark, "geojson")
    geojson.write_geojson(t.documents, path)
    lookup = geojson.cell_lookup(geojson.read_geojson(t.spark, path, multiline=False))
    ring = F.col("shape.coordinates")[0]
    return lookup.select(
        "grid_id",
        F.col("shape.type").alias("geometry_type"),
        F.size(ring).alias("ring_points"),
        ring[0][0].alias("first_longitude"),
        ring[0][1].alias("first_latitude"),
    )


@query
def geo_enrich(t):
    joined = geo.geo_enrich(t.hourly, t.some_lookup)
    return joined.select(
        "grid_id",
        "timestamp",
        "total_activity",
        F.get_json_object("geometry", "$.type").alias("geometry_type"),
    )


@query
def geo_coverage(t):
    return geo.geo_coverage(t.hourly, t.some_lookup)


@query
def unmatched_cells(t):
    return geo.unmatched_cells(t.hourly, t.some_lookup)


@query
def geometry_types(t):
    return geo.geometry_types(t.lookup)


@query
def geo_validate(t):
    return geo.geo_validate(t.hourly, t.some_lookup)


@query
def hotspots_geo(t):
    top = geo.hotspots_geo(rollup.hotspots(t.hourly), t.some_lookup)
    kind = F.get_json_object("geometry", "$.type").alias("geometry_type")
    return top.select("grid_id", "total_activity", kind)


# --- star schema --------------------------------------------------------------------------


@query
def dim_time(t):
    return t.dim_time


@query
def dim_grid(t):
    return t.dim_grid


@query
def dim_upsert(t):
    """The second half of the month arrives when the first half is already keyed."""
    first = star.dim_time(t.hourly.filter(F.col("timestamp") >= "2024-01-16"))
    return star.dim_time(t.hourly, existing=first)


@query
def alert_style_upsert(t):
    """Rows of one table replaced by the rows of another on a natural key."""
    stored = t.hourly.select("grid_id", "timestamp", F.col("total_sms").alias("v"))
    incoming = t.hourly.filter(F.hour("timestamp") >= 12)
    incoming = incoming.select("grid_id", "timestamp", F.col("total_calls").alias("v"))
    return tables.upsert(stored, incoming, ["grid_id", "timestamp"])


@query
def fact_build(t):
    return t.fact


@query
def fact_load(t):
    """What a re-run appends when the first week is loaded already, into a table with a folder per day."""
    fact = materialise(star.fact_build(t.hourly, t.dim_grid, t.dim_time, dated=True), "fact")
    path = scratch_dir(t.spark, "loaded")
    files.write_partitioned(fact.filter(F.col("date_value") < "2024-01-08"), path, by="date_value")
    return star.fact_load(t.spark.read.parquet(path), fact).drop("date_value")


@query
def dimension_coverage(t):
    known = t.dim_grid.filter(F.col("grid_id") % 3 != 0)
    return star.dimension_coverage(t.hourly, known, t.dim_time)


@query
def star_history(t):
    return star.star_history(t.fact, t.dim_grid, t.dim_time)


@query
def warehouse_checks(t):
    """Over facts damaged by rule, so that the checks have something to find."""
    mark = F.col("grid_key") * 31 + F.col("time_key")
    measure = F.when(mark % 89 != 0, F.col("sms_in")).alias("sms_in")
    damaged = t.fact.select(*[measure if c == "sms_in" else c for c in t.fact.columns])
    damaged = damaged.unionByName(damaged.filter(mark % 97 == 0))
    cells = t.lookup.agg(F.count("*")).scalar()
    return star.warehouse_checks(t.dim_grid, t.dim_time, damaged, expected_cells=cells)


# --- publication --------------------------------------------------------------------------


@query
def hourly_checks(t):
    return checks.hourly_checks(t.hourly)


@query
def publish_gate(t):
    return checks.publish_gate(checks.hourly_checks(t.hourly))


@query
def audit_sample(t):
    return checks.audit_sample(t.hourly.select("grid_id", "timestamp", "total_activity"), 7)


# --- trailing windows and labels ----------------------------------------------------------


@query
def cadence_gaps(t):
    return trailing.cadence_gaps(t.hourly.select("grid_id", "timestamp"))


@query
def cadence_gaps_network(t):
    """Steps between the distinct hours of each day file."""
    hours = t.hourly.select("date", "timestamp").distinct()
    return trailing.cadence_gaps(hours, by=["date"])


@query
def cadence_gaps_feed(t):
    """Steps between the distinct hours of the whole feed, across midnight too."""
    return trailing.cadence_gaps(t.hourly.select("timestamp").distinct(), by=[])


@query
def sequences(t):
    return trailing.sequences(t.hourly)


@query
def features(t):
    return t.features


@query
def features_pop(t):
    return trailing.features(t.hourly, variant="pop")


@query
def feature_table(t):
    return trailing.feature_table(t.hourly)


@query
def feature_checks(t):
    return checks.feature_checks(t.features)


@query
def feature_describe(t):
    return checks.describe(trailing.feature_table(t.hourly), MODEL_FEATURES)


@query
def trailing_median(t):
    return t.medians


@query
def next_hour_label(t):
    return t.labels


@query
def ml_dataset(t):
    return trailing.ml_dataset(t.features, t.labels)


@query
def training_table(t):
    return t.training


@query
def target_ratio_stats(t):
    return checks.describe(
        t.labels,
        ["target_ratio", "trailing_median_24h", "target_activity"],
        extra=[0.9, 0.95, 0.975, 0.99],
    )


@query
def target_ratio_near(t):
    return trailing.target_ratio_rows(t.labels)


@query
def class_balance(t):
    return trailing.class_balance(t.labels)


@query
def leakage_check(t):
    return trailing.leakage_check(t.hourly, "2024-01-16 12:00:00")


# --- rule alerts --------------------------------------------------------------------------


@query
def daily_coverage(t):
    return rules.daily_coverage(t.hourly)


@query
def activity_floor(t):
    return rules.activity_floor(t.hourly)


@query
def loo_baseline(t):
    return rules.loo_baseline(t.hourly)


@query
def hotspot_ratio(t):
    return rollup.hotspot_ratio(rules.loo_baseline(t.hourly))


@query
def alerts(t):
    return t.alerts


@query
def alerts_any_day(t):
    return rules.alerts(t.hourly, require_complete_day=False)


@query
def alert_summary(t):
    return rules.alert_summary(t.hourly, t.alerts)


@query
def alert_top_cells(t):
    return rules.alert_top_cells(t.alerts)


@query
def alert_type_summary(t):
    return rules.alert_type_summary(t.alerts)


@query
def alert_load_checks(t):
    return rules.alert_load_checks(t.alerts)


@query
def alert_grain_check(t):
    twice = t.alerts.unionByName(t.alerts.filter(F.col("alert_type") == "ACTIVITY_DROP"))
    return rollup.grain_check(twice, ["grid_id", "timestamp", "alert_type"])


# --- same-hour anomalies ------------------------------------------------------------------


@query
def anomalies(t):
    return t.anomalies


@query
def anomalies_increment(t):
    """The last week's hours against the state of those before it."""
    late = F.col("timestamp") >= "2024-01-24"
    return anomaly.anomalies_increment(anomaly.order_state(t.hourly.filter(~late)), t.hourly.filter(late))


@query
def anomalies_long_history(t):
    """The history in three runs: each scores its days against the state and adds them to it."""
    cuts = [F.col("timestamp") >= day for day in ("2024-01-11", "2024-01-21")]
    first, second, third = (t.hourly.filter(f) for f in (~cuts[0], cuts[0] & ~cuts[1], cuts[1]))
    state = anomaly.order_state(first)
    later = anomaly.merge_state(state, second)
    return (
        anomaly.anomalies(first)
        .unionByName(anomaly.anomalies_increment(state, second))
        .unionByName(anomaly.anomalies_increment(later, third))
    )


@query
def bucket_coverage(t):
    return anomaly.bucket_coverage(t.hourly, expected_cells=t.lookup.agg(F.count("*")).scalar())


@query
def low_history_buckets(t):
    return anomaly.low_history_buckets(t.hourly, min_history=30)


@query
def anomaly_summary(t):
    return anomaly.anomaly_summary(t.anomalies)


@query
def anomaly_checks(t):
    return anomaly.anomaly_checks(t.anomalies)


@query
def baseline_audit(t):
    return anomaly.baseline_audit(t.hourly, t.anomalies, 5)


# --- detector comparison ------------------------------------------------------------------


def _compared(t):
    return compare.detector_compare(t.predictions, t.anomalies, t.alerts)


@query
def detector_compare(t):
    return _compared(t)


@query
def detector_shares(t):
    return compare.category_shares(_compared(t), compare.CATEGORY_COLUMNS)


@query
def anomaly_vs_rules(t):
    return compare.anomaly_vs_rules(t.anomalies, t.alerts, t.predictions)


@query
def detector_agreement(t):
    return compare.detector_agreement(_compared(t))


@query
def disagreement_profile(t):
    return compare.disagreement_profile(_compared(t))


@query
def disagreement_hours(t):
    return compare.disagreement_hours(_compared(t))


@query
def disagreement_examples(t):
    return compare.disagreement_examples(_compared(t))


# --- served questions ---------------------------------------------------------------------

AS_OF = "2024-01-20 18:00:00"


@query
def network_summary(t):
    return serve.network_summary(t.hourly, AS_OF)


@query
def network_summary_strict(t):
    return serve.network_summary(t.hourly, AS_OF, strict_as_of=True)


@query
def grid_activity(t):
    return serve.grid_activity(t.hourly)


@query
def grid_activity_date(t):
    return serve.grid_activity(t.hourly, cells=[1, 2], as_of=AS_OF, date="2024-01-20")


@query
def grid_activity_hour(t):
    return serve.grid_activity(t.hourly, as_of=AS_OF, hour=9)


@query
def grid_activity_from(t):
    return serve.grid_activity(t.hourly, as_of=AS_OF, from_date="2024-01-10", hour=9)


@query
def features_as_of(t):
    latest = t.hourly.agg(F.max("timestamp")).scalar()
    return serve.features_as_of(t.features, t.requests, latest)


@query
def anomaly_as_of(t):
    return serve.anomaly_as_of(t.anomalies.drop("reason"), t.requests)


@query
def alerts_feed(t):
    return serve.alerts_feed(t.alerts, AS_OF)


@query
def alerts_feed_filtered(t):
    return serve.alerts_feed(
        t.alerts, AS_OF, severity="medium", alert_type="ACTIVITY_DROP", limit=20
    )


@query
def alert_hotspots(t):
    return serve.alert_hotspots(t.alerts, AS_OF)


@query
def grid_location(t):
    asked = t.grid_pairs.select(F.col("grid_b").alias("grid_id"))
    return serve.grid_location(t.dim_grid, asked)


@query
def grid_stats(t):
    return serve.grid_stats(t.hourly)


@query
def composition(t):
    return serve.composition(t.hourly)


@query
def compare_grids(t):
    return serve.compare_grids(t.hourly, t.grid_pairs)


@query
def compare_days(t):
    return serve.compare_days(t.hourly, t.day_pairs)


@query
def compare_days_hourly(t):
    return serve.compare_days_hourly(t.hourly, t.day_pairs)


@query
def alert_context(t):
    return serve.alert_context(t.alerts, t.anomalies, t.medians)


@query
def alert_status_map(t):
    return serve.alert_status_map(t.alerts)


@query
def evidence_summary(t):
    return serve.evidence_summary(t.hourly, t.alerts)


# --- learning: splits and metrics on a stand-in score -------------------------------------


@query
def chrono_split(t):
    return ml.chrono_split(t.training).select("grid_id", "feature_timestamp", "split")


@query
def split_report(t):
    return ml.split_report(ml.chrono_split(t.training))


@query
def split_checks(t):
    return ml.split_checks(ml.chrono_split(t.training))


@query
def class_weights(t):
    weighted = ml.class_weights(t.training)
    return weighted.select("grid_id", "feature_timestamp", "high_activity", "weight")


@query
def ml_eval(t):
    return metrics.ml_eval(t.scored_training)


@query
def confusion_matrix(t):
    return metrics.confusion_matrix(t.scored_training)


@query
def predicted_classes(t):
    return metrics.predicted_classes(t.scored_training)


@query
def threshold_sweep(t):
    return metrics.threshold_sweep(t.scored_training)


@query
def ml_baseline(t):
    return metrics.ml_eval(metrics.majority_baseline(t.training))


@query
def model_compare(t):
    return metrics.compare_models(
        t.scored_training,
        {
            "majority": (F.lit(0), F.lit(0.0)),
            "default": ("prediction", "probability"),
            "tuned": (F.col("probability") >= 0.35, "probability"),
        },
    )


@query
def risk_levels(t):
    return ml.risk_levels(t.scored_training, "stand-in")


# --- learning: fitted models; what SQL can say about any sound fit --------------------------


def _facts(scored, threshold=0.5):
    """Rows and classes of a scored test set, and how often class and probability disagree."""
    matrix = metrics.ml_eval(scored).select(
        F.struct(
            (F.col("tp") + F.col("fn")).alias("positives_in_matrix"),
            (F.col("fp") + F.col("tn")).alias("negatives_in_matrix"),
            (F.col("roc_auc").between(0, 1) & F.col("average_precision").between(0, 1)).alias("ranking_in_range"),
        )
    ).scalar()
    facts = scored.agg(
        F.count("*").alias("rows_scored"),
        F.sum("high_activity").cast("long").alias("positives"),
        F.count_if(_disagree("prediction", "probability", threshold)).alias("class_disagrees"),
        F.count_if(~F.col("probability").between(0, 1)).alias("odd_probabilities"),
    )
    names = ("positives_in_matrix", "negatives_in_matrix", "ranking_in_range")
    return facts.withColumns({name: matrix[name] for name in names})


def _disagree(prediction, probability, threshold=0.5):
    said, p = F.col(prediction) == 1, F.col(probability)
    return (said & (p < threshold)) | (~said & (p > threshold))


@query
def ml_dt(t):
    train, test = ml.prepare(t.training)
    return _facts(ml.predict(ml.fit_tree(train), test))


@query
def ml_dt_plain(t):
    train, test = ml.prepare(t.training)
    return _facts(ml.predict(ml.fit_plain_tree(train), test))


@query
def ml_lr(t):
    train, test = ml.prepare(t.training)
    return _facts(ml.predict(ml.fit_lr(train), test))


@query
def ml_lr_coefficients(t):
    """The likelihood's slope in every input is 0 at the fitted coefficients."""
    train, _ = ml.prepare(t.training)
    model = ml.fit_lr(train, log1p=False)
    scored = ml.predict(model, train)
    spread = train.agg(
        F.struct(
            *[F.stddev_samp(c).alias(f"s_{c}") for c in MODEL_FEATURES],
            *[F.avg(c).alias(f"m_{c}") for c in MODEL_FEATURES],
        )
    ).scalar()
    miss = F.col("weight") * (F.col("high_activity") - F.col("probability"))
    sums = scored.withColumn("_spread", spread).agg(
        *[
            (F.abs(F.sum(miss * (F.col(c) - F.col(f"_spread.m_{c}")) / F.col(f"_spread.s_{c}"))) / F.sum("weight")).alias(c)
            for c in MODEL_FEATURES
        ]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) < 1e-3).alias("solved")) for c in MODEL_FEATURES])
    known = ml.lr_coefficients(model, t.spark).select("feature", (F.abs("coefficient") == F.col("absolute_coefficient")).alias("sized"))
    return sums.select(F.inline(rows)).join(F.broadcast(known), "feature")


@query
def ml_lr_coefficients_table(t):
    """Coefficients as fitted, with their places by absolute size."""
    train, _ = ml.prepare(t.training)
    return ml.lr_coefficients(ml.fit_lr(train), t.spark)


@query
def ml_importance_table(t):
    """Importances as fitted, their places and the share of the two strongest."""
    train, _ = ml.prepare(t.training)
    return ml.ml_importance(ml.fit_tree(train), t.spark)


@query
def ml_tune_table(t):
    """All validation metrics of the grid."""
    train, _ = ml.prepare(t.training)
    return ml.tune_tree(train)


@query
def ml_predictions_table(t):
    """Class and probability of both models beside each test row."""
    train, test = ml.prepare(t.training)
    return ml.ml_predictions({"logistic": ml.fit_lr(train), "tree": ml.fit_tree(train)}, test)


@query
def training_audit(t):
    """Medians, targets and labels of every fifth key worked out again from the hours themselves."""
    stored = materialise(t.hourly, "hourly")
    return trailing.training_audit(stored, trailing.training_table(stored), 5)


@query
def ml_gbt(t):
    train, test = ml.prepare(t.training)
    scored = ml.predict(ml.fit_gbt(train), test)
    return _facts(metrics.at_threshold(scored, 0.3), 0.3)


@query
def ml_tune(t):
    train, _ = ml.prepare(t.training)
    tuned = ml.tune_tree(train)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return tuned.select(
        "max_depth", "min_samples_leaf", n.alias("rows_validated"), (F.col("tp") + F.col("fn")).alias("positives")
    )


@query
def ml_importance(t):
    train, _ = ml.prepare(t.training)
    found = ml.ml_importance(ml.fit_tree(train), t.spark)
    total = found.agg(F.sum("importance")).scalar()
    return found.select(
        "feature",
        F.col("importance").between(0, 1).alias("in_range"),
        (F.abs(total - 1) < 1e-9).alias("adds_to_one"),
    )


@query
def ml_predictions(t):
    train, test = ml.prepare(t.training)
    found = ml.ml_predictions({"logistic": ml.fit_lr(train), "tree": ml.fit_tree(train)}, test)
    return found.select(
        "grid_id",
        "feature_timestamp",
        "target_timestamp",
        "high_activity",
        (~_disagree("prediction_logistic", "probability_logistic")).alias("logistic_agrees"),
        (~_disagree("prediction_tree", "probability_tree")).alias("tree_agrees"),
    )


@query
def ml_roundtrip(t):
    train, test = ml.prepare(t.training)
    return ml.ml_roundtrip(ml.fit_tree(train), scratch_dir(t.spark, "model"), test)


@query
def risk_scores(t):
    train, _ = ml.prepare(t.training)
    return ml.risk_scores(ml.fit_tree(train), trailing.feature_table(t.hourly))


@query
def risk_scores_checked(t):
    """Every column of the risk records but the score, which is a fit's, against the score."""
    train, _ = ml.prepare(t.training)
    scored = ml.risk_scores(ml.fit_tree(train), trailing.feature_table(t.hourly))
    score = F.col("risk_score")
    floor = F.when(F.col("risk_level") == "CRITICAL", 0.8).when(F.col("risk_level") == "HIGH", 0.6)
    floor = floor.when(F.col("risk_level") == "MEDIUM", 0.3).otherwise(0.0)
    top = F.when(F.col("risk_level") == "CRITICAL", 1.1).when(F.col("risk_level") == "HIGH", 0.8)
    top = top.when(F.col("risk_level") == "MEDIUM", 0.6).otherwise(0.3)
    told = F.regexp_extract("explanation_note", r"risk is ([0-9.]+)%", 1).cast("double")
    return scored.select(
        "grid_id",
        "feature_timestamp",
        score.between(0, 1).alias("score_in_range"),
        ((score >= floor) & (score < top)).alias("band_fits"),
        (F.abs(told - 100 * score) <= 0.05 + 1e-9).alias("note_fits"),
        F.regexp_replace("explanation_note", r"[0-9.]+%", "x%").alias("note"),
        "model_version",
    )
