"""Reports, scheduling of due sites, sinks and small helpers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from galewatch.config import EngineConfig
from galewatch.functions import geo, text
from galewatch.plans import engine, reports
from galewatch.sources import sites, volumes
from galewatch.streaming import schedule, sinks


def test_due_sites(spark):
    t0 = datetime(2024, 1, 1)
    names = spark.createDataFrame([("A",), ("B",), ("C",)], "site string")
    states = spark.createDataFrame([("A", t0, 60, 0), ("B", t0, 900, 20)], "site string, finished_at timestamp, delay_seconds int, priority int")
    queue = schedule.due_queue(states, names, F.lit(t0 + timedelta(seconds=60)))
    assert [(r["site"], r["due"]) for r in queue.collect()] == [("A", True), ("C", True), ("B", False)]
    catalog = spark.createDataFrame([("A", t0.date(), "k1", "f1", 0), ("A", t0.date(), "k2", "", 1), ("A", t0.date(), "k3_MDM", None, 2), ("B", t0.date(), "b", "b", 0)], "site string, scan_date date, key string, filename string, ord int")
    got = engine.due_scans(catalog, spark.createDataFrame([("k2",)], "key string"), queue).collect()
    assert [(r["site"], r["key"]) for r in got] == [("A", "k1")]
    done = spark.createDataFrame([("A", "processed", 2, 1, 1, 0)], "site string, status string, cells_found int, chips_processed int, raw_detections int, detections int")
    assert {(r["site"], r["status"]) for r in engine.attempts_of(done, queue).collect()} == {("A", "processed"), ("C", "no_new_scan")}


def test_listing_functions(spark):
    t0 = datetime(2024, 1, 2)
    catalog = spark.createDataFrame([("A", t0.date(), f"k{i}", f"KTLX20240102_0{i}0000_V06" + ("_MDM" if i == 2 else ""), i) for i in range(4)], "site string, scan_date date, key string, filename string, ord int")
    assert [r["key"] for r in volumes.list_scans(catalog, " a ", "2024-01-02").collect()] == ["k0", "k1", "k3"]
    assert volumes.list_scans(catalog, "A", "2024-01-03", "2024-01-09").count() == 0
    assert volumes.scan_by_filename(catalog, "KTLX20240102_010000_V06").first()["key"] == "k1"
    assert volumes.latest_scans(catalog).first()["key"] == "k3"
    assert spark.range(1).select(text.scan_time_from_units(F.lit("seconds since 2024-01-02T03:04:05Z"))).first()[0] == datetime(2024, 1, 2, 3, 4, 5)


def test_labels_keep_apart(spark):
    rows = [("m", 1, 0.0, 0.0, "a"), ("m", 2, 0.5, 0.0, "b"), ("m", 3, 2.0, 0.0, "c"), ("m", 4, 0.9, 0.0, "d"), ("n", 1, 0.0, 0.0, "e")]
    got = reports.spaced_labels(spark.createDataFrame(rows, "map string, rank int, x double, y double, name string"), "map", 1.0, 1.0)
    assert sorted(r["name"] for r in got.collect()) == ["a", "c", "e"]


def test_helpers(spark):
    one = spark.createDataFrame([([1, 2],), (None,)], "a array<int>")
    assert [r[0] for r in one.select(reports.padded(F.col("a"), 3, "int")).collect()] == [[1, 2, None], [None] * 3]
    p = spark.createDataFrame([(0.7, None, None), (0.2, None, None), (0.7, True, False)], "p double, above boolean, act boolean")
    flags = reports.decision_flags(F.col("p"), F.lit(0.6), F.col("above"), F.col("act"))
    assert [tuple(r) for r in p.select(*flags).collect()] == [(True, True), (False, False), (True, False)]
    times = spark.createDataFrame([("k", "parse", 2.0), ("k", "score", 3.0)], "scan_key string, stage string, seconds double")
    assert {(r["stage"], r["total"], r["is_longest"]) for r in reports.stage_times(times).collect()} == {("parse", 5.0, False), ("score", 5.0, True)}
    labels = spark.createDataFrame([(0.0005,), (0.25,), (0.0,)], "p double").select(text.probability_label(F.col("p")))
    assert [r[0] for r in labels.collect()] == ["0.0005", "0.250", "0.000"]
    az, km = geo.xy_polar(F.lit(-3.0), F.lit(4.0))
    assert list(spark.range(1).select(F.round(az, 4), km).first()) == [323.1301, 5.0]


def test_overlay_falls_back_to_the_centroid(spark):
    rows = [("KTLX", True, 10.0, 50.0, None, None), ("KTLX", True, 10.0, 50.0, 20.0, 60.0), ("KTLX", False, 0.0, 1.0, None, None)]
    cells = spark.createDataFrame(rows, "site string, above_threshold boolean, az_deg double, range_km double, activation_az_deg double, activation_range_km double")
    got = reports.overlay_hits(cells, sites.core_sites(spark)).collect()
    assert len(got) == 2 and sum(r["hit_lat"] == r["lat"] for r in got) == 1


def test_destination_known_points(spark):
    # Along the equator a degree is a * pi / 180 metres; northwards from it the meridian arc is shorter.
    lat, lon = geo.destination(F.lit(0.0), F.lit(10.0), F.lit(90.0), F.lit(111.3194908))
    r = spark.range(1).select(lat, lon).first()
    assert r[0] == pytest.approx(0, abs=1e-9) and r[1] == pytest.approx(11.0, abs=1e-7)
    lat, lon = geo.destination(F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(110.5743886))
    assert spark.range(1).select(lat).first()[0] == pytest.approx(1.0, abs=1e-6)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 1)], "site string, n int")
    write = sinks.idempotent(str(tmp_path / "out"))
    for _ in range(2):
        write(df, 0)
    write(df, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["site"] == "A"
    sinks.append(df, str(tmp_path / "p"), ["site"])
    sinks.append(df, str(tmp_path / "p"), ["site"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_track_table(spark):
    t0 = datetime(2024, 1, 1)

    def track(name, hits, confirmed=True):
        obs = [(t0 + timedelta(minutes=5 * i), "c", 0.9 if h else 0.1, h == 1, None if h is None else 1.0, None if h is None else 1.0, None, None, True, [], h is None) for i, h in enumerate(hits)]
        return (name, "A", t0, t0 if confirmed else None, obs)

    from galewatch.schemas import TRACKS

    tracks = spark.createDataFrame([track("t1", [1, 1, 1]), track("t2", [1, 1, None]), track("t3", [1, 1]), track("t4", [1], False)], TRACKS)
    latest = spark.createDataFrame([("A", t0 + timedelta(minutes=10))], "site string, latest_scan_time timestamp")
    table = reports.track_table(tracks, latest, EngineConfig())
    assert {r["track_id"]: r["status"] for r in table.collect()} == dict(zip(("t1", "t2", "t3", "t4"), reports.TRACK_STATUS))
    assert reports.track_paths(tracks, spark.createDataFrame([("A", 30.0, -100.0)], "site_id string, lat double, lon double")).count() == 8
    assert [r["track_id"] for r in table.orderBy(*reports.track_order()).collect()][-1] == "t4"
