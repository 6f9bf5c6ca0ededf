"""Derived phase, map extents by sketches, places on many maps, and measured stages."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL, same
from pyspark.sql import functions as F

from galewatch.functions import phase
from galewatch.operators.scoring import ContrastScorer
from galewatch.plans import engine, measured, report_queries, reports, stream_queries
from galewatch.plans.catalog import ORACLES
from galewatch.sources import sites, volumes
from galewatch.streaming import tracker


@pytest.mark.parametrize("name", ["derived_phase", "places_on_maps", "chip_channels", "site_listing", "plot_gates", "track_paths", "results_csv"])
def test_queries_equal_sql(spark, name):
    sf_dir = SMALL.replace("0.001", "0.01") if name == "places_on_maps" else SMALL  # the small one has few places on maps
    assert same(spark, sf_dir, getattr(report_queries, name), ORACLES[name]) > 0


def test_slopes_equal_least_squares(spark):
    rng = random.Random(1)
    rays = [[None if rng.random() < 0.3 else 40 + 0.02 * i * i + rng.gauss(0, 3) for i in range(n)] for n in (1800, 300, 7, 1)] + [[], None, [None] * 50, [5.0] * 20, [float("nan")] * 3]
    df = spark.createDataFrame([(i, r, 0.25) for i, r in enumerate(rays)] + [(20, [1.0, 2.0] * 5, 0.0), (21, [1.0, 2.0] * 5, None)], "id int, phi array<double>, km double")
    got = {r["id"]: r["k"] for r in df.select("id", phase.specific_phase(F.col("phi"), F.col("km"), 12, 5).alias("k")).collect()}
    for i, ray in enumerate(rays):
        if ray is None:
            assert got[i] is None
            continue
        want = []
        for g in range(len(ray)):
            own = [(x, ray[x]) for x in range(max(0, g - 12), min(len(ray), g + 13)) if ray[x] is not None and not math.isnan(ray[x])]
            want.append(np.polyfit(*zip(*own), 1)[0] / 2 / 0.25 if len(own) >= 5 else None)
        assert len(got[i]) == len(want) and all((a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-7)) for a, b in zip(got[i], want))
    assert got[20] == got[21] == [None] * 10


def test_decoding_derives_missing_phase_only(spark):
    def decoder(path, content):
        rays = pd.DataFrame({"sweep_idx": [0, 0], "ray_idx": [0, 1], "azimuth_deg": [0.0, 1.0], "elevation_deg": [0.5, 0.5], "differential_phase": [[float(2 * g) for g in range(20)], None]})
        if content == b"has":
            rays["specific_differential_phase"] = [[9.0] * 20, None]
        return rays.assign(scan_time=pd.Timestamp("2024-05-01"), lat=35.0, lon=-97.0, range_m=[[500.0 * g for g in range(20)]] * 2)

    files = spark.createDataFrame([("K", "a", "a", bytearray(b"")), ("K", "b", "b", bytearray(b"has"))], "site string, scan_key string, path string, content binary")
    got = {(r["scan_key"], r["ray_idx"]): r["specific_differential_phase"] for r in volumes.decode(files, decoder).rays.collect()}
    assert got[("a", 0)] == pytest.approx([2.0] * 20) and got[("a", 1)] is None and got[("b", 0)] == [9.0] * 20


def test_extents_of_large_scans(spark):
    n = 2 * reports.SKETCH
    gates = spark.range(3 * n).select(F.when(F.col("id") < n, "a").when(F.col("id") < n + 100, "small").otherwise("b").alias("k"), F.rand(1).alias("lon"), F.randn(2).alias("lat"))
    gates = gates.unionByName(gates.limit(5).select("k", F.lit(float("nan")).alias("lon"), F.lit(None).cast("double").alias("lat"))).cache()
    pandas = gates.toPandas()
    for r in reports.map_extent(gates, ["k"]).collect():
        lon = np.sort(pandas[pandas.k == r["k"]]["lon"].dropna().to_numpy())
        west, east = (r["west"] * 1.05 + r["east"] * 0.05) / 1.1, (r["east"] * 1.05 + r["west"] * 0.05) / 1.1  # unpadded, as the padding is 5 %
        if len(lon) < 1000:
            pad = max(0.1, 0.05 * (np.quantile(lon, 0.999) - np.quantile(lon, 0.001)))
            assert (r["west"], r["east"]) == pytest.approx((np.quantile(lon, 0.001) - pad, np.quantile(lon, 0.999) + pad))
        elif r["east"] - r["west"] > 1.19:  # the least padding of a tenth
            west, east = r["west"] + 0.1, r["east"] - 0.1
            ranks = np.searchsorted(lon, [west, east]) / len(lon)
            assert abs(ranks - [0.001, 0.999]).max() < 0.0006


def test_places_on_maps_of_all_sizes(spark):
    rng = random.Random(2)
    places = [(f"p{i}", rng.uniform(-180, 180), rng.uniform(-90, 90), rng.choice([None, rng.randrange(10**6)])) for i in range(1500)] + [("edge", 10.0, 20.0, 5), ("twin", 10.0, 20.0, 5)]
    maps = [(i, w := rng.uniform(-180, 170), w + (s := rng.choice([0.01, 0.5, 3, 40, 300])), h := rng.uniform(-90, 80), h + s / 2) for i in range(60)]
    maps += [(100, 10.0, 10.0, 20.0, 20.0), (101, 5.0, 4.0, 0.0, 9.0), (102, None, 4.0, 0.0, 9.0), (103, -180.0, 180.0, -90.0, 90.0)]
    found = reports.places_on_maps(spark.createDataFrame(places, "name string, lon double, lat double, pop_max long"), spark.createDataFrame(maps, "map int, west double, east double, south double, north double"), 0, 25)
    got = sorted((r["map"], r["place_rank"], r["name"]) for r in found.collect())
    want = []
    for m, w, e, s, n in maps:
        inside = sorted((-(p or 0), name) for name, x, y, p in places if None not in (w, e, s, n) and w <= x <= e and s <= y <= n)
        want += [(m, k, name) for k, (_, name) in enumerate(inside[:25], 1)]
    assert got == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stages_are_measured(spark):
    rays, own = report_queries._sweeps(spark, SMALL)
    own = own.withColumn("scan_time", F.timestamp_seconds(F.col("scan_key").cast("long") * 300)).withColumns({"lat": F.lit(35.0), "lon": F.lit(-97.0)})
    rays, own = rays.withColumn("site", F.lit("KTLX")), own.withColumn("site", F.lit("KTLX"))
    stages = measured.Stages(spark, "pass")
    done = engine.process_scans(rays, own, sites.core_sites(spark), ContrastScorer, report_queries.SMALL, stages)
    rows = {r["stage"]: r for r in reports.stage_times(stages.table()).collect()}
    assert list(rows) and set(rows) == {"identified", "scored", "tracked", "results", "detections"}
    counts = {"identified": done.cells.count(), "scored": done.cells.count(), "tracked": done.updates.count(), "results": done.results.count(), "detections": done.detections.count()}
    assert {k: r["rows"] for k, r in rows.items()} == counts and counts["scored"] > 0
    assert sum(r["is_longest"] for r in rows.values()) == 1 and rows["scored"]["total"] == pytest.approx(sum(r["seconds"] for r in rows.values()))
    times = measured.BatchTimes()
    spark.streams.addListener(times)
    try:
        scans = tracker.scans_of(done.cells, own.select("site", "scan_key", "scan_time"))
        stream_queries.fed(spark, [scans], lambda s: tracker.stream(s))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(times)
    table = times.table(spark).where("stage = 'addBatch'")
    assert table.agg(F.sum("rows")).first()[0] == scans.count() and table.where("seconds > 0").count() > 0
