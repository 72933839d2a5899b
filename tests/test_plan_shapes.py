"""What the physical plans must look like."""

import re

import pytest

from pyspark.sql import functions as F

from cellpulse.functions.asof import as_of_join
from cellpulse.functions.quantiles import exact_quantiles
from cellpulse.functions.unique import one_row_per
from cellpulse.operators import alerts, anomaly, compare, features, geo, metrics, rollup, serve, star
from cellpulse.plans.tables import Tables
from cellpulse.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hourly"))
    files.write_partitioned(Tables(spark, sf_dir).hourly, path)
    return spark.read.parquet(path)


def test_scan_reads_only_needed_columns(stored):
    text = plan(rollup.hotspots(stored))
    assert re.search(r"ReadSchema: struct<grid_id:int,total_activity:double>", text)
    assert "TakeOrderedAndProject" in text


def test_date_window_prunes_partitions(stored):
    text = plan(rollup.hotspots(stored, "2024-01-08", "2024-01-09"))
    filters = re.search(r"PartitionFilters: \[(.*?)\]", text).group(1)
    assert "date" in filters and ">=" in filters and "<=" in filters


def test_time_filter_is_pushed_down(stored):
    text = plan(serve.grid_activity(stored, cells=[1], as_of="2024-01-20 18:00:00"))
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(timestamp", text)


def test_small_lookup_is_broadcast_and_large_one_is_not(spark, stored, sf_dir, tmp_path):
    Tables(spark, sf_dir).lookup.write.parquet(str(tmp_path / "l"))
    lookup = spark.read.parquet(str(tmp_path / "l"))
    assert "BroadcastHashJoin" in plan(geo.geo_enrich(stored, lookup))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert "SortMergeJoin" in plan(geo.geo_enrich(stored, lookup))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize(
    "build",
    [
        features.features,
        features.trailing_median,
        features.next_hour_label,
        features.training_table,
        alerts.scored_hours,
        alerts.loo_baseline,
    ],
)
def test_windows_share_one_shuffle(stored, build):
    text = plan(build(stored))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_training_table_sorts_once(stored):
    assert len(re.findall(r"\bSort \[", plan(features.training_table(stored)))) == 1


def test_group_limit_comes_before_the_shuffle(stored):
    text = plan(rollup.hotspot_rank(stored, 3))
    assert "WindowGroupLimit" in text


def test_partial_aggregation_before_the_shuffle(spark, sf_dir):
    text = plan(Tables(spark, sf_dir).hourly)
    assert "partial_sum" in text
    assert text.count("Exchange") == 1


def test_fact_load_reads_the_days_of_its_batch(spark, stored, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    fact = star.fact_build(stored, t.dim_grid, star.dim_time(stored), dated=True)
    files.write_partitioned(fact, str(tmp_path / "fact"), by="date_value")
    loaded = spark.read.parquet(str(tmp_path / "fact"))
    loaded.filter("date_value between '2024-01-09' and '2024-01-10'").write.parquet(str(tmp_path / "batch"))
    fresh = star.fact_load(loaded, spark.read.parquet(str(tmp_path / "batch")))
    assert fresh.count() == 0
    scans = [text for text in plan(fresh).split("FileScan parquet") if "PartitionFilters: [" in text]
    pruned = [text for text in scans if re.search(r"PartitionFilters: \[[^]]*date_value[^]]*ubquery", text)]
    assert pruned
    read = [line for line in metrics_of(fresh) if "date_value" in line[0]]
    assert [n for _, n in read] == [2]


def metrics_of(df):
    """(scan, partitions read) of every partitioned scan of an executed plan."""
    df.collect()
    found, queue = [], [df._jdf.queryExecution().executedPlan()]
    while queue:
        node = queue.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            queue.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            queue.append(node.plan())
        else:
            if node.nodeName().startswith("Scan"):
                metric = node.metrics().get("numPartitions")
                if metric.isDefined():
                    found.append((node.toString(), metric.get().value()))
            children = node.children()
            queue += [children.apply(i) for i in range(children.size())]
    return found


def test_growing_medians_hold_no_growing_list(stored):
    for frame in (
        anomaly.anomalies(stored),
        anomaly.anomalies_increment(anomaly.order_state(stored), stored),
    ):
        text = plan(frame)
        assert "Window" not in text and "Python" not in text
        assert text.count("Exchange hashpartitioning") == (1 if "Join" not in text else 2)


def exchanges(text):
    return len(re.findall(r"\b(?:Exchange|BroadcastExchange) ", text))


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """Stored predictions, anomalies, alerts, features and history."""
    t, path = Tables(spark, sf_dir), tmp_path_factory.mktemp("kept")
    found = {}
    for name in ("predictions", "anomalies", "alerts", "features", "medians", "hourly", "scored_training", "requests"):
        getattr(t, name).write.parquet(f"{path}/{name}")
        found[name] = spark.read.parquet(f"{path}/{name}")
    return found


def test_detectors_meet_in_one_exchange_each(kept):
    text = plan(compare.detector_compare(kept["predictions"], kept["anomalies"], kept["alerts"]))
    assert exchanges(text) <= 6 and text.count("FileScan") == 3


def test_detectors_in_buckets_meet_without_an_exchange(spark, kept, tmp_path):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = [
            files.write_bucketed(kept[name], f"bucketed_{name}", str(tmp_path / name), ["grid_id", "timestamp"], 4)
            for name in ("predictions", "anomalies", "alerts")
        ]
        compared = compare.detector_compare(*stored)
        assert exchanges(plan(compared)) == 0
        plain = compare.detector_compare(kept["predictions"], kept["anomalies"], kept["alerts"])
        assert compared.count() == plain.count() and compared.exceptAll(plain).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("predictions", "anomalies", "alerts"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")


def test_as_of_reads_the_history_once(kept):
    found = as_of_join(kept["anomalies"].drop("reason"), kept["requests"], "timestamp")
    text = plan(found)
    assert exchanges(text) <= 5 and text.count("FileScan") == 2


def test_models_are_compared_in_one_plan(kept):
    scored = kept["scored_training"]
    one = {"default": ("prediction", "probability")}
    many = one | {f"at {cut}": (F.col("probability") >= cut, "probability") for cut in (0.2, 0.3, 0.4, 0.5)}
    plans = [plan(metrics.compare_models(scored, models)) for models in (one, many)]
    # Models of one score are ranked once, however many there are.
    assert exchanges(plans[0]) == exchanges(plans[1]) and "Python" not in plans[1]


def test_rows_before_a_row_need_no_whole_cell(kept):
    text = plan(features.features(kept["hourly"], variant="pop"))
    windows = re.findall(r"Window \[(.*?)\], \[(.*?)\]", text)
    over_cells = [w for w, by in windows if re.fullmatch(r"grid_id#\d+", by)]
    # Only the counts of the time blocks are put in order per cell.
    assert len(windows) > 1 and all("count" in w for w in over_cells) and len(over_cells) == 1


def test_quantiles_expand_no_rows(kept):
    found = exact_quantiles(kept["features"], ["avg_activity", "peak_ratio", "variability"], [0.1, 0.5, 0.9])
    text = plan(found)
    assert "Expand" not in text
    # What is unnested are the few values inside brackets and one row of counts.
    assert all("_hits" in g or "struct" in g for g in re.findall(r"Generate inline\((.*?)\)", text))


@pytest.mark.parametrize("name", ["profile", "hourly_checks", "network_summary"])
def test_one_scan_for_all_facts(spark, sf_dir, kept, name):
    from cellpulse.operators import checks

    build = {
        "profile": lambda: rollup.profile(Tables(spark, sf_dir).raw),
        "hourly_checks": lambda: checks.hourly_checks(kept["hourly"]),
        "network_summary": lambda: serve.network_summary(kept["hourly"], "2024-01-20 18:00:00"),
    }
    text = plan(build[name]())
    assert text.count("FileScan") <= 2 and "Expand" not in text


def test_keys_that_must_be_unique(spark, kept):
    features_twice = kept["features"].unionByName(kept["features"].limit(1))
    labels = Tables(spark, "/root/testdata/sf0.01").labels
    with pytest.raises(Exception, match="features: more than one row with grid_id="):
        features.ml_dataset(features_twice, labels).count()
    with pytest.raises(Exception, match="anomalies: more than one row"):
        twice = kept["anomalies"].unionByName(kept["anomalies"].filter("grid_id = 1"))
        compare.detector_compare(kept["predictions"], twice, kept["alerts"]).collect()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        key = ["grid_id", "feature_timestamp"]
        plain = exchanges(plan(kept["features"].join(kept["medians"], key)))
        checked = exchanges(plan(one_row_per(kept["features"], key).join(one_row_per(kept["medians"], key), key)))
        assert plain == checked == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
