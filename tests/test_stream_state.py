"""Streams with timers and named state, and state read back out of checkpoints."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from conftest import SMALL, normal, same
from pyspark.sql import functions as F

from galewatch.config import EngineConfig
from galewatch.plans import stream_queries as queries
from galewatch.plans.catalog import ORACLES
from galewatch.plans.views import candidates, scans
from galewatch.streaming import dedup, schedule, tracker
from galewatch.streaming.stores import PROVIDER, rocksdb

START = datetime(2024, 5, 1)


@pytest.mark.parametrize("name", ["stream_sliding_dedup", "stream_due_sites", "saved_open_tracks", "latest_snapshot"])
def test_queries_equal_sql(spark, name):
    assert same(spark, SMALL, getattr(queries, name), ORACLES[name]) > 0


def test_every_sighting_keeps_a_key(spark):
    """Sightings an hour apart keep a key for ever; a longer pause makes it new; null is a key; repeats count once."""
    hours = {"a": [0, 1, 2, 3, 4, 4], "b": [0, 3], None: [0, 0, 1]}
    parts = [[(k, START + timedelta(hours=h)) for k, hs in hours.items() for h in hs if low <= h < low + 2] for low in (0, 2, 4)]
    frames = [spark.createDataFrame(p, "key string, time timestamp") for p in parts]
    config = EngineConfig(processed_ttl_seconds=3600)
    with rocksdb(spark):
        root = queries.fed(spark, frames, lambda s: dedup.sliding_first_seen(s, config=config))
    assert spark.conf.get(PROVIDER, None) is None or "RocksDB" not in spark.conf.get(PROVIDER)
    got = sorted(((r["key"] or "", r["time"]) for r in spark.read.parquet(f"{root}/out").collect()))
    assert got == [("", START), ("a", START), ("b", START), ("b", START + timedelta(hours=3))]


def test_timers_tell_when_sites_are_due(spark):
    rows = [("s", 1, START, 60, 5), ("s", 2, START + timedelta(seconds=30), 60, 0), ("t", 3, START + timedelta(seconds=40), 3600, 20), ("s", 4, START + timedelta(seconds=200), 60, 15), ("u", 5, START + timedelta(seconds=900), 0, 1)]
    frames = [spark.createDataFrame(p, "site string, seq long, finished_at timestamp, delay_seconds int, priority int") for p in (rows[:2], rows[2:])]
    with rocksdb(spark):
        root = queries.fed(spark, frames, schedule.due_sites)
    got = sorted((r["site"], (r["due_at"] - START).total_seconds(), r["priority"]) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [("s", 90, 0), ("s", 260, 15), ("u", 900, 1)]  # t isn't due yet


def test_replay_goes_on_from_saved_tracks(spark):
    config = EngineConfig()
    rows = scans(candidates(spark, SMALL)).withColumn("s", F.unix_seconds("scan_time"))
    first, rest = (p.drop("s") for p in queries.halves(rows, "s"))
    root = queries.fed(spark, [first], lambda s: tracker.stream(s, config))
    saved = tracker.saved_state(spark, f"{root}/state")
    assert saved.dtypes == spark.createDataFrame([], tracker.SAVED).dtypes
    columns = ["site", "scan_time", "cell_id", "track_id", "status", "hits_in_window", "created_at", "confirmed_at"]
    got = tracker.replay(rest, config, start=saved).select(columns).toPandas()
    whole = tracker.replay(rows.drop("s"), config).select(columns).toPandas()
    late = whole[whole["scan_time"].isin(pd.to_datetime(rest.select("scan_time").distinct().toPandas()["scan_time"]))]
    assert normal(got) == normal(late) and len(got) > 100
