"""Windows, medians and lookups against brute force."""

import datetime as dt
import random
import statistics

import pytest
from conftest import HOURLY, at, hours
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellpulse.functions.asof import as_of_join
from cellpulse.functions.quantiles import exact_quantiles
from cellpulse.operators import alerts, anomaly, features, metrics

SLOW = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def series(spark, cell, times, values=None):
    values = values or [100.0 + 10 * i for i in range(len(times))]
    rows = [(cell, t, 10.0 + i, float(v)) for i, (t, v) in enumerate(zip(times, values))]
    return spark.createDataFrame(rows, HOURLY)


def test_future_rows_do_not_change_features(spark):
    past = series(spark, 1, hours("2026-01-01", 49))
    future = spark.createDataFrame([(1, at("2026-01-03 01:00"), 9999.0, 999999.0)], HOURLY)
    t = F.col("feature_timestamp") == at("2026-01-03 00:00")
    before = features.features(past).filter(t).first()
    after = features.features(past.union(future)).filter(t).first()
    assert before is not None and before == after
    assert features.leakage_check(past.union(future), "2026-01-03 00:00:00").first().leak_free


def test_two_hour_windows(spark):
    h = series(spark, 1, hours("2026-01-01", 4), [100, 200, 300, 999999])
    rows = {r.feature_timestamp: r for r in features.features(h, recent=2, prior=1).collect()}
    row = rows[at("2026-01-01 02:00")]
    assert row.avg_activity == 250.0 and row.activity_growth == pytest.approx(1.5)


def test_gap_ends_the_run(spark):
    times = [t for i, t in enumerate(hours("2026-01-01", 110)) if i != 55]
    h = series(spark, 1, times)
    seen = [r.feature_timestamp for r in features.features(h).collect()]
    expected = times[47:55] + times[55 + 47:]
    assert sorted(seen) == expected
    assert features.sequences(h).agg(F.max("sequence_id")).first()[0] == 2
    assert features.cadence_gaps(h).filter("cadence_gap").count() == 1
    assert features.features(h, variant="pop").count() == len(times) - 47


def test_zero_history_has_fixed_values(spark):
    h = series(spark, 1, hours("2026-01-01", 72), [0.0] * 24 + [0.0] * 24 + [5.0] * 24)
    rows = sorted(features.features(h).collect(), key=lambda r: r.feature_timestamp)
    assert (rows[0].activity_growth, rows[0].peak_ratio, rows[0].internet_share) == (0, 0, 0)
    assert rows[-1].activity_growth == 1.0
    pop = features.features(h, variant="pop").orderBy(F.desc("feature_timestamp")).first()
    assert pop.activity_growth == 0.0


@pytest.mark.parametrize("block_hours", [24, 50, 24 * 28, 10**6])
def test_time_blocks_change_nothing(spark, block_hours):
    rng = random.Random(7)
    times = [t for t in hours("2026-01-01", 400) if rng.random() > 0.01]
    h = series(spark, 1, times, [rng.randint(0, 50) for _ in times]).union(
        series(spark, 2, hours("2026-01-05", 120))
    )
    whole = {"block_hours": 10**7}
    for build in (
        features.features,
        features.trailing_median,
        features.next_hour_label,
        features.training_table,
    ):
        assert sorted(build(h, block_hours=block_hours).collect()) == sorted(
            build(h, **whole).collect()
        )


def test_training_table_equals_join(spark):
    rng = random.Random(3)
    times = [t for t in hours("2026-01-01", 300) if rng.random() > 0.005]
    h = series(spark, 4, times, [rng.randint(0, 50) for _ in times])
    joined = features.ml_dataset(features.features(h), features.next_hour_label(h))
    fused = features.training_table(h)
    assert fused.count() > 0
    assert sorted(fused.collect()) == sorted(joined.select(fused.columns).collect())


def others_median(values, i):
    rest = values[:i] + values[i + 1:]
    return statistics.median(rest) if rest else None


@SLOW
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=24), min_size=1, max_size=6))
def test_leave_one_out_median(spark, days):
    rows, expected = [], {}
    for d, values in enumerate(days):
        for i, t in enumerate(hours(f"2026-01-{d + 1:02d}", len(values))):
            rows.append((1, t, 0.0, float(values[i])))
            expected[t] = others_median([float(v) for v in values], i)
    got = alerts.loo_baseline(spark.createDataFrame(rows, HOURLY)).collect()
    assert {r.timestamp: r.baseline_activity for r in got} == expected


@SLOW
@given(st.lists(st.integers(0, 20), min_size=1, max_size=30), st.integers(0, 30), st.sampled_from([1, 2, 5, 16]))
def test_expanding_median_whole_and_from_state(spark, values, cut, block):
    times = [at("2026-01-01 05:00").replace(day=1 + i) for i in range(len(values))]
    h = series(spark, 1, times, values)
    expected = {
        t: None if i < 3 else statistics.median(map(float, values[:i]))
        for i, t in enumerate(times)
    }
    old, new = (h.filter((F.col("timestamp") > at("2026-01-01").replace(day=1 + cut)) == late) for late in (False, True))
    state = anomaly.order_state(old)
    in_parts = anomaly.anomalies(old, block=block).union(anomaly.anomalies_increment(state, new, block=block))
    for scored in (anomaly.anomalies(h, block=block), in_parts):
        got = scored.collect()
        assert {r.timestamp: r.historical_baseline for r in got} == expected
        assert all(r.baseline_count == times.index(r.timestamp) for r in got)
    merged = anomaly.merge_state(state, new).collect()
    assert [r.past for r in merged] == [sorted(map(float, values))]


def test_expanding_median_of_a_long_history(spark):
    """Years of one bucket, with missing values, against a plain median."""
    rng = random.Random(3)
    days = [at("2020-01-01 05:00") + dt.timedelta(days=i) for i in range(800)]
    values = [None if rng.random() < 0.05 else float(rng.choice([rng.randint(0, 9), rng.random() * 9])) for _ in days]
    rows = [(1, t, 0.0, v) for t, v in zip(days, values, strict=True)]
    got = {r.timestamp: r for r in anomaly.anomalies(spark.createDataFrame(rows, HOURLY)).collect()}
    seen = []
    for t, v in zip(days, values, strict=True):
        assert got[t].baseline_count == len(seen)
        assert got[t].historical_baseline == (statistics.median(seen) if len(seen) >= 3 else None)
        seen += [] if v is None else [v]


def test_zero_baseline_fires_high_and_drop(spark):
    h = series(spark, 1, hours("2026-01-01", 24), [0.0] * 24)
    kinds = {r.alert_type for r in alerts.alerts(h).collect()}
    assert kinds == {"HIGH_ACTIVITY", "ACTIVITY_SPIKE", "ACTIVITY_DROP"}


def test_incomplete_day_has_no_alert_unless_allowed(spark):
    h = series(spark, 1, hours("2026-01-01", 23), [10.0] * 22 + [100.0])
    assert alerts.alerts(h).count() == 0
    found = alerts.alerts(h, require_complete_day=False).collect()
    assert {(r.alert_type, r.baseline_activity) for r in found} == {
        ("HIGH_ACTIVITY", 10.0),
        ("ACTIVITY_SPIKE", 10.0),
    }
    assert found[0].reason.startswith("Current activity 100.00 is at least 1.50x")


def test_quantiles_with_brackets_are_exact(spark):
    rng = random.Random(1)
    values = [float(rng.choice([rng.randint(0, 40), rng.random()])) for _ in range(6000)]
    df = spark.createDataFrame(
        [("a" if i % 3 else "b", v) for i, v in enumerate(values)], "g string, x double"
    ).repartition(7)
    qs = [0.0, 0.1, 0.5, 0.975, 1.0]
    import numpy as np

    for kwargs in ({}, {"accuracy": 200}):
        got = exact_quantiles(df, ["x"], qs, by=["g"], **kwargs).collect()
        assert len(got) == 10
        for r in got:
            group = [v for i, v in enumerate(values) if (i % 3 != 0) == (r.g == "a")]
            assert r.value == pytest.approx(np.quantile(group, r.q), abs=1e-12)


def test_as_of_join_carries_over_blocks(spark):
    rng = random.Random(5)
    facts = sorted(rng.sample(range(0, 3000), 40))
    start = hours("2026-01-01", 1)[0]
    import datetime as dt

    def time(h, minutes=0):
        return start + dt.timedelta(hours=h, minutes=minutes)

    history = spark.createDataFrame(
        [(1, time(h), float(h), None if h % 2 else "even") for h in facts],
        "grid_id int, t timestamp, v double, note string",
    )
    asked = [rng.randint(-50, 3200) for _ in range(200)]
    requests = spark.createDataFrame(
        [(1, time(h, 30)) for h in asked] + [(2, time(5))], "grid_id int, as_of timestamp"
    )
    for block_hours in (10, 672):
        got = as_of_join(history, requests, "t", block_hours=block_hours).collect()
        assert len(got) == len(set(asked)) + 1
        for r in got:
            h = (r.as_of - start).total_seconds() / 3600
            best = max((f for f in facts if f <= h), default=None) if r.grid_id == 1 else None
            assert r.v == best
            assert r.note == (None if best is None or best % 2 else "even")


def brute_ranking(rows):
    p = sum(y for y, _ in rows)
    n = len(rows) - p
    wins = sum(
        (a > b) + (a == b) / 2 for y, a in rows if y for z, b in rows if not z
    )
    ap = 0.0
    for s in {s for _, s in rows}:
        at_least = [y for y, v in rows if v >= s]
        ap += sum(y for y, v in rows if v == s) / p * sum(at_least) / len(at_least)
    return wins / (p * n), ap


@pytest.mark.parametrize("digits", [1, 9])
def test_ranking_metrics(spark, digits):
    rng = random.Random(digits)
    rows = [(int(rng.random() < 0.3), round(rng.random() ** 3, digits)) for _ in range(900)]
    pred = spark.createDataFrame(rows, "high_activity int, probability double")
    got = metrics.ranking_metrics(pred).first()
    auc, ap = brute_ranking(rows)
    assert got.roc_auc == pytest.approx(auc) and got.average_precision == pytest.approx(ap)
