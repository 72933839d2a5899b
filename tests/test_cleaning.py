"""Literal one- and two-row cases of cleaning and roll-ups."""

from conftest import at

from cellpulse.operators import clean, rollup
from cellpulse.schemas import RAW_SCHEMA, RAW_TEXT_SCHEMA


def raw(spark, *rows):
    rows = [(at(ts), cell, country, *[None if v is None else float(v) for v in values])
            for ts, cell, country, *values in rows]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_null_measures_become_zero(spark):
    row = clean.clean(raw(spark, ("2013-11-01 00:00", 1, 0, None, 5, None, 3, 20))).first()
    assert (row.sms_in, row.call_in, row.sms_out) == (0.0, 0.0, 5.0)


def test_time_parts(spark):
    cleaned = clean.clean(raw(spark, ("2013-11-01 14:00", 1, 0, 10, 5, 2, 3, 20)))
    row = clean.time_parts(cleaned).first()
    assert row.hour == 14 and str(row.date) == "2013-11-01" and row.day_name == "Friday"
    assert (row.dow_sunday_1, row.dow_sunday_0, row.dow_monday_0) == (6, 5, 4)


def test_countries_collapse(spark):
    cleaned = clean.clean(
        raw(
            spark,
            ("2013-11-01 10:00", 1, 0, 10, 5, 2, 1, 10),
            ("2013-11-01 10:00", 1, 33, 20, 5, 3, 2, 20),
        )
    )
    rows = rollup.hourly_summary(cleaned).collect()
    assert len(rows) == 1 and "country_code" not in rows[0].asDict()
    assert (rows[0].sms_in, rows[0].internet_activity) == (30.0, 30.0)
    multi = rollup.multi_country(cleaned).first()
    assert multi.countries == 2


def test_totals_and_share(spark):
    cleaned = clean.clean(raw(spark, ("2013-11-01 10:00", 1, 0, 10, 5, 2, 3, 20)))
    row = rollup.hourly_summary(cleaned).first()
    assert (row.total_sms, row.total_calls, row.total_activity) == (15.0, 5.0, 40.0)
    assert row.internet_share == 0.5


def test_zero_activity_has_zero_share(spark):
    cleaned = clean.clean(raw(spark, ("2013-11-01 10:00", 1, 0, None, None, None, None, None)))
    assert rollup.hourly_summary(cleaned).first().internet_share == 0.0


def test_kpis_add_up(spark):
    batch = raw(
        spark,
        ("2013-11-01 10:00", 1, 0, 10, 5, 2, 1, 10),
        ("2013-11-01 11:00", 1, 0, 20, 5, 3, 2, 20),
    )
    cleaned = clean.clean(batch)
    row = rollup.kpis(batch, cleaned, rollup.hourly_summary(cleaned)).first()
    assert (row.unique_grids, row.busiest_grid, row.busiest_hour) == (1, 1, 11)
    assert (row.total_sms, row.total_calls, row.input_rows) == (40.0, 8.0, 2)


def test_structural_nulls_and_negatives_are_rejected(spark):
    batch = raw(
        spark,
        ("2013-11-01 10:00", 1, 0, 1, 1, 1, 1, 1),
        ("2013-11-01 10:00", None, 0, 1, 1, 1, 1, 1),
        ("2013-11-01 10:00", 2, 0, 1, 1, -1, 1, None),
    )
    refused = clean.rejected(batch)
    assert refused.count() == 2 and clean.clean(batch).count() == 1
    row = clean.row_balance(batch, clean.clean(batch), refused).first()
    assert row.balanced
    both = clean.with_verdict(batch).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in both} == {"clean": 1, "rejected": 2}


def test_text_that_does_not_parse_is_null_not_an_error(spark):
    batch = spark.createDataFrame(
        [("2013-11-01 10:00:00", "1", "0", "x", None, "2.5", "", "1e3"),
         ("yesterday", "1", "0", "1", "1", "1", "1", "1")],
        RAW_TEXT_SCHEMA,
    )
    good, bad = clean.clean(batch).first(), clean.rejected(batch).first()
    assert (good.sms_in, good.call_in, good.internet_activity) == (0.0, 2.5, 1000.0)
    assert bad.timestamp is None


def test_ranking_ties_go_to_the_smaller_cell(spark):
    cleaned = clean.clean(
        raw(
            spark,
            ("2013-11-01 10:00", 7, 0, 1, 1, 1, 1, 1),
            ("2013-11-01 10:00", 3, 0, 1, 1, 1, 1, 1),
            ("2013-11-01 11:00", 3, 0, 1, 1, 1, 1, 1),
            ("2013-11-01 11:00", 7, 0, 1, 1, 1, 1, 1),
        )
    )
    hourly = rollup.hourly_summary(cleaned)
    assert [r.grid_id for r in rollup.hotspots(hourly).collect()] == [3, 7]
    assert rollup.peak_per_grid(hourly).filter("grid_id = 7").first().peak_activity_hour == at(
        "2013-11-01 10:00"
    )
    top = rollup.hotspot_rank(hourly, 1).collect()
    assert {r.grid_id for r in top} == {3}
