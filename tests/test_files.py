"""Files, gate, geometry and loads on small folders."""

import json

import pytest
from conftest import at
from pyspark.sql import functions as F

from cellpulse.operators import checks, geo, star
from cellpulse.plans import curation, warehouse
from cellpulse.schemas import FILE_PATTERN
from cellpulse.sources import files, gate, geojson, tables

HEADER = "datetime,CellID,countrycode,smsin,smsout,callin,callout,internet"


def day(folder, date, n_hours=24, header=HEADER, first="1.5,1,1,1,1"):
    lines = [header]
    for h in range(n_hours):
        values = first if h == 0 else "1.5,1,1,1,1"
        if header != HEADER:
            values = values.rsplit(",", 1)[0]
        lines.append(f"{date} {h:02d}:00:00,{h % 2 + 1},39,{values}")
    path = folder / f"sms-call-internet-mi-{date}.csv"
    path.write_text("\n".join(lines) + "\n")


@pytest.fixture
def landing(tmp_path):
    day(tmp_path, "2013-11-01")
    day(tmp_path, "2013-11-02", first=",1,1,1,1")
    day(tmp_path, "2013-11-03", n_hours=23)
    day(tmp_path, "2013-11-04", first="1,1,-2,1,1")
    day(tmp_path, "2013-11-05", header=HEADER.rsplit(",", 1)[0])
    day(tmp_path, "2013-11-06", n_hours=0)
    day(tmp_path, "2013-11-07", first="oops,1,1,1,1")
    swapped = HEADER.replace("smsin,smsout", "smsout,smsin")
    day(tmp_path, "2013-11-08")
    path = tmp_path / "sms-call-internet-mi-2013-11-08.csv"
    path.write_text(path.read_text().replace(HEADER, swapped))
    return f"{tmp_path}/{FILE_PATTERN}"


def test_gate_verdicts(spark, landing):
    text = files.read_raw(spark, landing, text=True)
    rows = gate.ingest_gate(text, files.file_headers(spark, landing)).collect()
    verdict = {r.filename[-6:-4]: (r.status, r.row_count, r.reason) for r in rows}
    assert verdict == {
        "01": ("ACCEPTED", 24, "Minimum quality validation passed"),
        "02": ("ACCEPTED", 24, "Non-numeric values found in smsin: 1"),
        "03": ("REJECTED", 23, "Expected exactly 24 distinct hourly timestamps, found 23"),
        "04": ("REJECTED", 24, "Negative activity values found in callin: 1"),
        "05": ("REJECTED", 24, "Missing required column(s): internet"),
        "06": ("REJECTED", 0, "File contains zero rows"),
        "07": ("ACCEPTED", 24, "Non-numeric values found in smsin: 1"),
        "08": ("REJECTED", 24, "Unexpected order of columns"),
    }


def test_typed_scan_and_empty_match(spark, landing):
    raw = files.read_raw(spark, landing.replace("*", "2013-11-01"))
    row = raw.orderBy("datetime").first()
    assert row.datetime == at("2013-11-01") and row.smsin == 1.5
    assert row._source_file.endswith("/sms-call-internet-mi-2013-11-01.csv")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_raw(spark, landing.replace("*", "none-*")).count()


def test_status_of_a_run(spark, landing):
    text = files.read_raw(spark, landing, text=True)
    verdicts = gate.ingest_gate(text, files.file_headers(spark, landing))
    hourly = spark.createDataFrame([(at("2013-11-01 23:00"), 1)], "timestamp timestamp, grid_id int")
    row = gate.run_status(verdicts, hourly, "2013-11-02 00:30:00").first()
    assert (row.rows_in, row.rows_rejected, row.rows_published) == (167, 95, 1)
    assert row.freshness == "FRESH" and row.healthy and row.reasons == []
    row = gate.run_status(
        verdicts, hourly.limit(0), "2013-11-02 00:30:00", {"load_warehouse": "FAILED"}
    ).first()
    assert row.freshness == "UNKNOWN" and not row.healthy and len(row.reasons) == 2


def test_curation_runs_twice_with_the_same_result(spark, landing, tmp_path):
    out = str(tmp_path / "curated")
    for _ in range(2):
        paths = curation.curate(spark, landing, out, gated=True, now=at("2013-11-08"))
        hourly = spark.read.parquet(paths["hourly_grid_summary"])
        assert hourly.count() == 72
        assert spark.read.parquet(paths["clean_activity"]).count() == 72
        assert spark.read.parquet(f"{out}/rejected_files").count() == 95
    nulls = spark.read.parquet(paths["null_profile"]).filter("column_name = 'smsin'").first()
    assert nulls.null_count == 2  # a blank and a text
    assert paths["published"]
    assert files.readback_checks(hourly, paths["hourly_grid_summary"]).first().passed
    dashboard = spark.read.option("header", True).csv(paths["dashboard"])
    assert dashboard.count() == 72
    record = spark.read.json(f"{out}/status").collect()
    assert len(record) == 1
    assert (record[0].status, record[0].rows_in, record[0].rows_rejected, record[0].rows_published) == ("SUCCESS", 167, 95, 72)
    assert record[0].tasks.asDict() == {"publish": "SUCCESS", "spark_process": "SUCCESS"}
    assert record[0].freshness.indicator in ("FRESH", "RECENT", "STALE") and record[0].nulls_handled == 2


def test_gate_reads_the_text_once_and_only_the_folders_asked_for(spark, landing, tmp_path):
    """The staged gate gives the verdicts of the gate over three reads, and its rows the same rows."""
    from cellpulse.session import scratch_table

    extra = tmp_path / "sms-call-internet-mi-2013-11-09.csv"
    day(tmp_path, "2013-11-09")
    extra.write_text(extra.read_text() + HEADER + "\n")  # a second header is a row that cannot be read
    with scratch_table(files.staged_lines(spark, landing), "lines", by=["_file"]) as staged:
        verdicts = gate.staged_gate(staged)
        plain = gate.ingest_gate(files.read_raw(spark, landing, text=True), files.file_headers(spark, landing))
        columns = ["filename", "status", "row_count", "reason"]
        assert sorted(map(tuple, verdicts.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
        with scratch_table(verdicts, "verdicts") as stored:
            accepted, refused = gate.staged_route(staged, stored)
            assert accepted.count() == 72 and refused.count() == 23 + 24 + 24 + 24 + 25
            text = accepted._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(_file" in text and "dynamicpruning" in text
            raw = files.read_raw(spark, landing, text=True).join(stored.filter("status = 'ACCEPTED'"), F.col("_source_file") == F.col("filename"))
            assert accepted.exceptAll(raw.select(accepted.columns)).isEmpty()


def test_redelivered_days_replace_themselves_only(spark, tmp_path):
    """Two batches, then the first one corrected: nothing of the second is touched."""
    out = str(tmp_path / "curated")
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    two.mkdir()
    day(one, "2013-11-01", first="1,1,1,NaN,1")
    extra = one / "sms-call-internet-mi-2013-11-01.csv"
    extra.write_text(extra.read_text() + "not a time,1,39,1,1,1,1,1\n2013-11-01 05:00:00,2,39,-1,1,1,1,1\n")
    day(two, "2013-11-02")
    other = two / "sms-call-internet-mi-2013-11-02.csv"
    other.write_text(other.read_text() + "no time either,1,39,1,1,1,1,1\n")

    def run(folder):
        return curation.curate(spark, f"{folder}/{FILE_PATTERN}", out)

    def counts(paths):
        rejected = spark.read.option("basePath", f"{out}/activity").parquet(f"{out}/activity")
        return (
            rejected.filter("verdict = 'clean'").count(),
            rejected.filter("verdict = 'rejected'").count(),
            spark.read.parquet(paths["hourly_grid_summary"]).count(),
        )

    assert counts(run(one)) == (24, 2, 24)
    paths = run(two)
    assert counts(paths) == (48, 3, 48)
    total = spark.read.parquet(paths["hourly_grid_summary"]).agg({"total_activity": "sum"}).first()[0]
    assert total == total  # no NaN
    day(one, "2013-11-01")
    assert counts(run(one)) == (48, 1, 48)


def test_failing_checks_leave_the_published_tables(spark, tmp_path):
    out = str(tmp_path / "curated")
    day(tmp_path, "2013-11-01")
    first = curation.curate(spark, f"{tmp_path}/{FILE_PATTERN}", out)
    assert first["published"]
    before = spark.read.parquet(first["hourly_grid_summary"]).count()
    day(tmp_path, "2013-11-01", n_hours=5)
    second = curation.curate(spark, f"{tmp_path}/{FILE_PATTERN}", out)
    assert not second["published"]
    assert spark.read.parquet(first["hourly_grid_summary"]).count() == before
    failed = spark.read.parquet(second["checks"]).filter("not passed")
    assert [r.check_name for r in failed.collect()] == ["days_without_24_hours"]


def test_equal_names_in_two_folders_are_two_files(spark, tmp_path):
    for name, first in (("a", "1,1,1,1,1"), ("b", "-1,1,1,1,1")):
        (tmp_path / name).mkdir()
        day(tmp_path / name, "2013-11-01", first=first)
    pattern = f"{tmp_path}/*/{FILE_PATTERN}"
    text = files.read_raw(spark, pattern, text=True)
    verdicts = gate.ingest_gate(text, files.file_headers(spark, pattern)).collect()
    assert sorted((r.filename.split("/")[-2], r.status) for r in verdicts) == [("a", "ACCEPTED"), ("b", "REJECTED")]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from cellpulse import session

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "local-cluster[2,1,1024]"})

    with pytest.raises(ValueError, match="checkpoint"):
        session.scratch_dir(Cluster(), "x")
    with session.scratch_table(spark.range(3), "x") as table:
        path = table.inputFiles()[0].rpartition("/")[0]
        assert table.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_sink_reruns_replace_their_days(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame(
        [(at("2026-01-01"), 1.0), (at("2026-01-02"), 2.0)], "timestamp timestamp, v double"
    ).selectExpr("*", "to_date(timestamp) AS date")
    files.write_partitioned(df, path)
    files.write_partitioned(df.filter("date = '2026-01-02'"), path)
    assert spark.read.parquet(path).count() == 2
    files.require_readback(df, path)
    files.write_checked(df.filter("date = '2026-01-01'"), path)
    files.write_checked(df.limit(0), path)
    missing = df.limit(1).selectExpr("timestamp", "v", "CAST(NULL AS DATE) AS date")
    files.write_checked(missing, path)
    files.write_checked(df.filter("date = '2026-01-01'"), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        files.write_checked(df.drop("v").filter("date = '2026-01-02'"), path, mode="append")
    with pytest.raises(ValueError):
        files.require_readback(df.filter("v > 1"), path)


def polygons(path):
    def feature(i, cell, kind="Polygon", coordinates=None):
        ring = [[i, 0.0], [i + 1, 0.0], [i + 1, 1.0], [i, 1.0], [i, 0.0]]
        return {
            "type": "Feature",
            "id": i,
            "properties": {"cellId": cell},
            "geometry": {"type": kind, "coordinates": coordinates or [ring]},
        }

    doc = {
        "type": "FeatureCollection",
        "features": [
            feature(0, 1),
            feature(1, 2),
            feature(9, 2),
            feature(2, None),
            feature(3, 4, "MultiPolygon", [[[[0.0, 0.0], [1.0, 0.0]]]]),
        ],
    }
    path.write_text(json.dumps(doc, indent=1))
    return str(path)


def test_geojson_lookup_and_dimension(spark, tmp_path):
    lookup = geojson.cell_lookup(geojson.read_geojson(spark, polygons(tmp_path / "g.geojson")))
    grids = {r.grid_id: r for r in star.dim_grid(lookup, "g.geojson").collect()}
    assert sorted(grids) == [1, 2, 4]
    assert grids[2].centroid_longitude == pytest.approx(1.4)
    assert grids[1].centroid_latitude == pytest.approx(0.4)
    assert grids[4].centroid_latitude is None and grids[4].geometry_ref == "g.geojson#4"
    cells = spark.createDataFrame([(1,), (3,)], "grid_id int")
    row = geo.geo_validate(cells, lookup).first()
    assert (row.cells, row.missing_geometry, row.valid) == (2, 1, False)


def test_warehouse_load_is_idempotent_and_keeps_keys(spark, tmp_path, landing):
    out = str(tmp_path / "curated")
    paths = curation.curate(spark, landing, out, gated=True, now=at("2013-11-08"))
    hourly = spark.read.parquet(paths["hourly_grid_summary"])
    lookup = geojson.cell_lookup(geojson.read_geojson(spark, polygons(tmp_path / "g.geojson")))
    where = {
        n: {"path": str(tmp_path / n)} for n in ("dim_time", "dim_grid", "fact_network_activity")
    }
    second_day = hourly.filter("date = '2013-11-02'")
    warehouse.load_warehouse(spark, second_day, lookup, "g", where)
    first_keys = {
        r.timestamp: r.time_key for r in spark.read.parquet(where["dim_time"]["path"]).collect()
    }
    for _ in range(2):
        loaded = warehouse.load_warehouse(spark, hourly, lookup, "g", where)
        times = {r.timestamp: r.time_key for r in loaded["dim_time"].collect()}
        assert len(times) == len(set(times.values())) == 72
        assert all(times[t] == k for t, k in first_keys.items())
        fact = spark.read.parquet(where["fact_network_activity"]["path"])
        assert fact.count() == 72
    row = star.warehouse_checks(loaded["dim_grid"], loaded["dim_time"], fact, 3).first()
    assert row.passed


def test_publish_only_when_checks_pass(spark):
    df = spark.range(1)
    good = spark.createDataFrame([("a", 0, True)], "check_name string, failures int, passed boolean")
    bad = good.union(spark.createDataFrame([("b", 2, False)], good.schema))
    written = []
    assert checks.publish(df, good, written.append) and len(written) == 1
    assert not checks.publish(df, bad, written.append) and len(written) == 1
    assert checks.publish_gate(bad).first().failed_checks == "b"


def test_upsert_and_new_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    merged = {r.k: r.v for r in tables.upsert(old, new, ["k"]).collect()}
    assert merged == {1: "a", 2: "c", 3: "d"}
    assert [r.k for r in tables.new_rows(old, new, ["k"]).collect()] == [3]
