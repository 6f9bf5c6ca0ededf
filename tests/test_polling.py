"""Rounds over due sites on an archive of made-up volumes, and the command line."""

import dataclasses
import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from galewatch.config import EngineConfig
from galewatch.functions.tables import children
from galewatch.operators.scoring import ContrastScorer
from galewatch.plans import polling
from galewatch.schemas import SCANS
from galewatch.sources import sites, volumes

START = datetime(2024, 5, 1, 12, 0)
SMALL = EngineConfig(cell_min_gates=4, chip_azimuth_bins=16, chip_range_gates=16, confidence_threshold=0.01, detection_min_gates=1)


def made():
    """A decoder that travels to workers by value."""

    def decoder(path, content):
        told = json.loads(content)
        if told.get("broken"):
            raise ValueError("broken")
        rows = []
        for ray in range(36):
            storm = abs(ray - told["ray"]) <= 1
            echo = [50.0 if storm and 20 <= g < 24 else None for g in range(40)]
            rows.append({"sweep_idx": 0, "ray_idx": ray, "azimuth_deg": ray * 10.0, "elevation_deg": 0.5, "reflectivity": echo, "velocity": [float(20 * (ray % 2)) if v else 0.0 for v in echo]})
        return pd.DataFrame(rows).assign(scan_time=pd.Timestamp(told["time"]), lat=35.0, lon=-97.0, range_m=[[1000.0 * (g + 1) for g in range(40)]] * 36)

    return decoder


def put(root, site, at, **told):
    folder = root / f"{at:%Y/%m/%d}" / site
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{site}{at:%Y%m%d_%H%M%S}_V06").write_text(json.dumps({"time": at.isoformat(), "ray": 10} | told))


def test_rounds(spark, tmp_path):
    archive, folder = tmp_path / "archive", str(tmp_path / "state")
    known = sites.core_sites(spark).where("site_id in ('KTLX', 'KDOX', 'KABR')")
    own = known.unionByName(known.limit(1).selectExpr("'KABX' site_id", "35.0 lat", "-106.0 lon", "1 elev_ft", "'x' name", "'UTC' timezone")).dropDuplicates(["site_id"])
    names = {r["site_id"] for r in own.collect()}
    put(archive, "KTLX", START)
    put(archive, "KDOX", START, broken=True)

    def round_at(minutes, **more):
        rows = polling.poll(spark, str(archive), folder, own, made(), ContrastScorer, SMALL, START + timedelta(minutes=minutes), **more).collect()
        return {r["site"]: r["status"] for r in rows}

    first = round_at(1)
    assert set(first) == names and first["KTLX"] == "processed" and first["KDOX"] == "error" and first["KABX"] == "no_new_scan"
    put(archive, "KTLX", START + timedelta(minutes=5))
    put(archive, "KTLX", START - timedelta(days=9))  # not listed
    asked = due(spark, folder, own, 6)
    second = round_at(6)
    assert set(second) == asked and second["KTLX"] == "processed" and set(second.values()) <= {"processed", "no_new_scan"}
    updates = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/updates").orderBy("scan_time").collect()
    assert [u["status"] for u in updates] == ["pending", "newly_confirmed"] and len({u["track_id"] for u in updates}) == 1  # the track goes on
    assert spark.read.parquet(f"{folder}/results").count() == 2 and spark.read.parquet(f"{folder}/detections").count() == 1
    assert spark.read.parquet(f"{folder}/processed").count() == 3
    assert "KTLX" not in due(spark, folder, own, 6.5) and "KTLX" in due(spark, folder, own, 8)
    assert set(round_at(6.6, overwrite=True)) == names  # every site is due again


@pytest.mark.parametrize("where", ["stream_scans", "scan_outcomes", "merge", "remove"])  # remove: after all tables are written
def test_a_round_that_is_cut_off_is_done_once(spark, tmp_path, monkeypatch, where):
    """A round fails at some step, the next call comes later: every scan is once in every table, and one scan alone confirms nothing."""
    archive, folder = tmp_path / "archive", str(tmp_path / "state")
    own = sites.core_sites(spark).where("site_id in ('KTLX', 'KDOX')")
    put(archive, "KTLX", START)
    put(archive, "KDOX", START)
    module = {"merge": polling.snapshot, "remove": polling}.get(where, polling.engine)
    calls, whole = [], getattr(module, where)

    def failing(*args, **more):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return whole(*args, **more)

    monkeypatch.setattr(module, where, failing)
    again = lambda minutes: polling.poll(spark, str(archive), folder, own, made(), ContrastScorer, SMALL, START + timedelta(minutes=minutes)).collect()
    with pytest.raises(RuntimeError):
        again(1)
    assert len(polling.unfinished(spark, folder)) == 1
    later = again(2)
    assert polling.unfinished(spark, folder) == []
    table = lambda name: spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/{name}")
    assert table("scans").count() == table("processed").count() == table("results").count() == 2
    assert [u["status"] for u in table("updates").collect()] == ["pending"] * 2 and table("detections").count() == 0
    first = table("attempts").where("status = 'processed'").collect()
    assert {(r["site"], r["finished_at"]) for r in first} == {(s, START + timedelta(minutes=1)) for s in ("KTLX", "KDOX")}  # under its own time
    assert {r["status"] for r in later} <= {"no_new_scan"}
    states = polling.snapshot.read(spark, f"{folder}/sites", polling.SITE_STATES).collect()
    assert all(r["activity_score"] == 3 and r["consecutive_no_new"] == (r["finished_at"] == START + timedelta(minutes=2)) for r in states)
    put(archive, "KTLX", START + timedelta(minutes=5))
    again(6)
    assert table("detections").count() == 1 and table("updates").where("status = 'newly_confirmed'").count() == 1


def test_a_scan_delivered_twice_confirms_nothing(spark, tmp_path):
    candidate = {"cand_idx": 0, "cell_id": "c", "probability": 0.9, "threshold": 0.6, "az_deg": 10.0, "range_km": 50.0, "activation_az_deg": 10.0, "activation_range_km": 50.0, "quality_pass": True, "reasons": []}
    row = spark.createDataFrame([("KTLX", START, [candidate])], SCANS)
    for _ in range(2):
        row.write.mode("append").parquet(str(tmp_path / "in"))
        polling.engine.stream_scans(spark.readStream.schema(SCANS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), SMALL).awaitTermination()
    assert [r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["pending"]


def test_rounds_read_no_logs(spark, tmp_path):
    """What a round reads doesn't grow with the rounds before it; old keys and taken files go."""
    archive, folder = tmp_path / "archive", str(tmp_path / "state")
    own = sites.core_sites(spark).where("site_id = 'KTLX'")
    config = dataclasses.replace(SMALL, processed_ttl_seconds=86_400)
    for k in range(4):
        at = START + timedelta(days=k)
        put(archive, "KTLX", at)
        polling.poll(spark, str(archive), folder, own, made(), ContrastScorer, config, at + timedelta(minutes=1))
    assert children(spark, f"{folder}/inbox") == children(spark, f"{folder}/pending") == []
    assert len(children(spark, f"{folder}/processed")) == 2 and len(children(spark, f"{folder}/attempts")) == 4
    states = polling.snapshot.read(spark, f"{folder}/sites", polling.SITE_STATES)
    assert states.count() == 1 and len(states.inputFiles()) == 1
    assert polling.processed_keys(spark, folder, at + timedelta(minutes=2), config).count() <= 2


def due(spark, folder, own, minutes):
    queue = polling.due_now(spark, folder, own.selectExpr("site_id site"), START + timedelta(minutes=minutes), SMALL)
    return {r["site"] for r in queue.where("due").collect()}


def test_reprocess_and_pruned_listing(spark, tmp_path):
    for k in range(3):
        put(tmp_path / "a", "KTLX", START + timedelta(minutes=5 * k))
    put(tmp_path / "a", "KTLX", START + timedelta(days=3))
    listed = volumes.read_catalog(spark, str(tmp_path / "a"), ["ktlx", "KDOX"], START.date(), START.date())
    assert [r["ord"] for r in listed.orderBy("ord").collect()] == [0, 1, 2]
    assert volumes.read_catalog(spark, str(tmp_path / "a"), ["KDOX"], START.date()).count() == 0
    assert volumes.read_catalog(spark, str(tmp_path / "a")).count() == 4
    done = polling.reprocess(spark, str(tmp_path / "a"), str(tmp_path / "out"), "KTLX", START, START, sites.core_sites(spark), made(), ContrastScorer, SMALL)
    assert [r["status"] for r in done.updates.orderBy("scan_time").collect()] == ["pending", "newly_confirmed", "confirmed"]
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/detections")).count() == 1


def test_workers_deal_sites_among_themselves(spark, tmp_path):
    archive, folder = tmp_path / "archive", str(tmp_path / "state")
    own = sites.core_sites(spark)
    shares = [polling.share(spark, folder, own, k, 3) for k in range(3)]
    ids = [{r["site_id"] for r in s.collect()} for _, s in shares]
    assert set.union(*ids) == {r["site_id"] for r in own.collect()} and sum(map(len, ids)) == own.count() and len({f for f, _ in shares}) == 3
    put(archive, "KTLX", START)
    done = {f: polling.poll(spark, str(archive), f, s, made(), ContrastScorer, SMALL, START + timedelta(minutes=1)).collect() for f, s in shares}
    assert [{r["site"] for r in done[f]} for f, _ in shares] == ids
    assert [(r["status"], r["raw_detections"]) for rows in done.values() for r in rows if r["site"] == "KTLX"] == [("processed", 1)]
    assert spark.read.option("recursiveFileLookup", "true").schema("scan_time string, site string").parquet(f"{folder}/worker=*/results").count() == 1
    # What is done with scans can be another function: here one that finds nothing over the threshold.
    put(archive, "KTLX", START + timedelta(minutes=5))
    weaker = lambda *args: polling.engine.scored_cells(*args).withColumns({"probability": F.lit(0.0), "above_threshold": F.lit(False)})
    f, s = next(x for x, names in zip(shares, ids) if "KTLX" in names)
    later = polling.poll(spark, str(archive), f, s, made(), ContrastScorer, SMALL, START + timedelta(minutes=6), overwrite=True, process=weaker).collect()
    assert [(r["status"], r["raw_detections"]) for r in later if r["site"] == "KTLX"] == [("processed", 0)]
    for wrong in ((0, 2), (0, 1), (3, 3)):
        with pytest.raises(ValueError):
            polling.share(spark, folder, own, *wrong)


def test_site_list(spark, capsys):
    from galewatch.__main__ import main

    main(["sites"])
    out = capsys.readouterr().out.splitlines()
    assert out[-1] == f"{len(out) - 1} sites" and any(line.startswith("KDOX\t38.82570") for line in out)
