"""Sweeps, segmentation, shear, chips, scoring and the whole pass over hand-built rays."""

from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galewatch.config import EngineConfig
from galewatch.operators import cells, chips, heatmap, scoring, sweeps
from galewatch.plans import engine
from galewatch.schemas import FIELDS, RAYS, VOLUMES
from galewatch.sources import sites, volumes


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=60, unique=True), st.randoms())
def test_labels_equal_flood_fill(points, rng):
    want, n = {}, 0
    for p in sorted(points):
        if p in want:
            continue
        n += 1
        todo = [p]
        while todo:
            y, x = todo.pop()
            if (y, x) in want or (y, x) not in set(points):
                continue
            want[y, x] = n
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    rng.shuffle(points)
    got = cells.labelled(np.array([p[0] for p in points]), np.array([p[1] for p in points]))
    assert [want[p] for p in points] == got.tolist()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(2, 14), st.integers(2, 14), st.integers(0, 99))
def test_resampling(rows, cols, to_rows, to_cols, seed):
    a = np.random.default_rng(seed).random((rows, cols)).astype(np.float32)
    out = chips.resampled(a, to_rows, to_cols)
    assert out.shape == (to_rows, to_cols) and out.min() >= a.min() - 1e-6 and out.max() <= a.max() + 1e-6
    assert np.allclose(out[[0, 0, -1, -1], [0, -1, 0, -1]], a[[0, 0, -1, -1], [0, -1, 0, -1]]) or rows == 1 or cols == 1
    assert np.isnan(chips.resampled(np.full((rows, cols), np.nan, np.float32), to_rows, to_cols)).all()
    assert chips.resampled(np.zeros((0, 3), np.float32), to_rows, to_cols).sum() == 0


def make(spark, n_rays=72, n_gates=120):
    """One volume with two tilts: a storm of 6 x 6 gates at ray 20, gate 60, with a velocity couplet."""
    rows = []
    for sweep, elev in ((0, 0.5), (1, 0.9)):
        for ray in range(n_rays):
            dbz = [55.0 if 18 <= ray <= 23 and 58 <= g <= 63 else None for g in range(n_gates)]
            vel = [(-20.0 if ray <= 20 else 20.0) if 15 <= ray <= 26 and 50 <= g <= 70 else float("nan") for g in range(n_gates)]
            rows.append(("KTLX", "KTLX-1", sweep, ray, ray * 5.0, elev, dbz, vel, None, None, None, None))
    rays = volumes.clean_rays(spark.createDataFrame(rows, RAYS))
    vols = spark.createDataFrame([("KTLX", "KTLX-1", datetime(2024, 1, 1), 0.0, 0.0, [1000.0 * g for g in range(n_gates)])], VOLUMES)
    return rays, vols


def test_one_storm_end_to_end(spark):
    rays, vols = make(spark)
    config = EngineConfig(cell_min_gates=20)
    table = sweeps.sweep_table(rays)
    assert sweeps.nearest_sweep(table, 0.6).first()["sweep_idx"] == 0
    assert sweeps.nearest_sweep(table, 2.0).count() == 0
    assert sweeps.field_sweeps(table, 0.9).first()["sweeps"] == {"reflectivity": 0, "velocity": 0}
    found = cells.identify_cells(rays, vols, config).collect()
    assert len(found) == 1
    c = found[0]
    assert (c["n_gates"], c["az_center_idx"], c["range_center_idx"], c["dbz_max"], c["cell_id"]) == (36, 20, 60, 55.0, "KTLX-1-C01")
    assert c["shear"] == pytest.approx(40.0 / (60.0 * np.radians(5.0)))
    out = engine.process_scans(rays, vols, sites.core_sites(spark), scoring.ContrastScorer, config)
    row = out.results.collect()[0]
    assert row["site"] == "KTLX" and row["az_deg"] == 100.0 and len(out.results.columns) == 11 and len(out.detections.columns) == 23
    assert out.updates.count() == 1
    scored = out.cells.first()
    assert 0 <= scored["edge_margin"] <= 0.5 and scored["activation_range_km"] == pytest.approx(60.0, abs=20)
    summary = engine.scan_outcomes(vols, cells.identify_cells(rays, vols, config), out.cells, out.updates).first()
    assert summary["status"] == "processed" and summary["chips_processed"] == 1
    assert cells.identify_cells(rays.where("false"), vols, config).count() == 0
    none = rays.withColumn("velocity", F.lit(None).cast("array<float>"))
    assert cells.identify_cells(none, vols, config).first()["shear"] == 0.0


def test_chip_of_a_cell(spark):
    rays, vols = make(spark)
    config = EngineConfig()
    one = cells.identify_cells(rays, vols, config)
    row = chips.chip_parts(one, rays, vols, config).first()
    chip = chips.assembled(row["parts"], row["range_lower_m"], row["range_upper_m"], config)
    assert {k: v.shape for k, v in chip.items()} == {k: (120, 240, 2) for k in chips.MODEL_KEYS}
    assert chip["DBZ"][:, :, 0].max() == pytest.approx(55.0) and not np.isnan(chip["VEL"]).any() and chip["KDP"].sum() == 0
    assert set(np.unique(chip["range_folded_mask"].round(3))) >= {0.0, 1.0}
    assert len(FIELDS) == 6


@pytest.mark.parametrize("gates,km,start,n", [(200, 3.0, 0, 60), (200, 199.0, 140, 60), (200, 100.0, 70, 60), (30, 10.0, 0, 30), (1, 5.0, 0, 1), (0, 5.0, 0, 0)])
def test_range_window_shifts_at_ends(spark, gates, km, start, n):
    df = spark.createDataFrame([([1000.0 * g for g in range(gates)], km)], "r array<double>, km double")
    w = df.select(chips.range_window(F.col("r"), F.col("km"), 60000.0, 240).alias("w")).first()["w"]
    if gates == 1:
        assert (w["start"], w["n"]) == (0, 1)
    else:
        assert (w["start"], w["n"]) == (start, n)


def test_azimuth_window_crosses_north(spark):
    df = spark.createDataFrame([([float(a) for a in range(0, 360, 10)],)], "a array<double>")
    got = df.select(chips.azimuth_window(F.col("a"), F.lit(5.0), 60.0).alias("w")).first()["w"]
    assert got == [34, 35, 0, 1, 2, 3]


def test_heatmap_peaks(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0, 0.0],), ([float("nan")] * 4,), (None,)], "h array<double>")
    assert [r[0] for r in df.select(heatmap.argmax(F.col("h"))).collect()] == [1, None, None]
    one = spark.range(1).select(heatmap.edge_margin(F.lit(0), F.lit(0), 1, 1), heatmap.edge_margin(F.lit(7), F.lit(7), 8, 8)).first()
    assert list(one) == [0.5, 0.0625]


def test_site_catalog(spark):
    rows = [("TJUA", 18.1, -66.1, 2900.0), ("TXXX", 1.0, 1.0, 5.0), ("KABR", 45.4, -98.4, -99999.0), ("KUDX", 44.1, -102.8, 3015.5)]
    got = {r["site_id"]: r for r in sites.build_catalog(spark, spark.createDataFrame(rows, "site_id string, lat double, lon double, elev double")).collect()}
    assert "TXXX" not in got and got["TJUA"]["name"] and got["KABR"]["elev_ft"] is None and got["KUDX"]["elev_ft"] == 3016
    assert got["KABR"]["timezone"] == "America/Chicago" and got["KUDX"]["timezone"] == "America/Denver" and got["KTLX"]["lat"] == 35.3331
    asked = spark.createDataFrame([("KTLX",), ("NOPE",)], "site string")
    with pytest.raises(ValueError, match="NOPE"):
        sites.require_known(asked, sites.core_sites(spark))
    vols = spark.createDataFrame([("KTLX", "k", datetime(2024, 1, 1), 0.0, 0.0, [0.0])], VOLUMES)
    assert sites.volume_coordinates(vols, sites.core_sites(spark)).first()["lat"] == 35.3331
    assert sites.listing(sites.core_sites(spark)).first()["line"] == "KDOX\t38.82570\t-75.44010\tDover, DE"


def test_decoder_failures_are_kept_apart(spark):
    import pandas as pd

    files = spark.createDataFrame([("KTLX", "a", "p1", b"ok"), ("KTLX", "b", "p2", b"bad")], "site string, scan_key string, path string, content binary")

    def decoder(path, content):
        if content == b"bad":
            raise ValueError("no volume")
        return pd.DataFrame({"sweep_idx": [0], "ray_idx": [0], "azimuth_deg": [0.5], "elevation_deg": [0.5], "reflectivity": [[1.0, 2.0]], "scan_time": [datetime(2024, 1, 1)], "lat": [1.0], "lon": [2.0], "range_m": [[250.0, 500.0]]})

    rays, own, failed = volumes.decode(files, decoder)
    assert [tuple(r) for r in own.collect()] == [("KTLX", "a", datetime(2024, 1, 1), 1.0, 2.0, [250.0, 500.0])]
    assert rays.first()["reflectivity"] == [1.0, 2.0] and rays.count() == 1
    assert [tuple(r) for r in failed.collect()] == [("p2", "KTLX", "b", "ValueError: no volume")]
