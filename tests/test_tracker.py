"""The tracker against a second implementation, written from the rules alone, and stream against batch."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import SMALL, normal
from hypothesis import given, settings
from hypothesis import strategies as st

from galewatch.config import EngineConfig
from galewatch.plans import radar_queries, stream_queries
from galewatch.schemas import SCANS
from galewatch.streaming import tracker

CONFIG = EngineConfig()


class Oracle:
    """Columns of arrays instead of track objects; all pairs are scored, then the cheapest free one is taken again and again."""

    def __init__(self):
        self.ids, self.seen, self.confirmed, self.n = [], [], [], 0

    def feed(self, site, at, cands):
        xy = lambda a, r: None if a is None or r is None else (r * math.sin(math.radians(a)), r * math.cos(math.radians(a)))
        obs = [dict(t=at, hit=c["probability"] >= c["threshold"], xy=xy(c["az_deg"], c["range_km"]), act=xy(c["activation_az_deg"], c["activation_range_km"])) for c in cands]
        costs = {}
        for k, h in enumerate(self.seen):
            real = [o for o in h if o]
            if not real:
                continue
            px, py = real[-1]["xy"]
            dt = (at - real[-1]["t"]) / 3600
            if len(real) > 1 and dt > 0 and real[-1]["t"] > real[-2]["t"]:
                f = dt / ((real[-1]["t"] - real[-2]["t"]) / 3600)
                px, py = px + (px - real[-2]["xy"][0]) * f, py + (py - real[-2]["xy"][1]) * f
            acts = [o["act"] for o in real if o["act"]]
            for c, o in enumerate(obs):
                d = math.dist(o["xy"], (px, py))
                extra = math.dist(o["act"], acts[-1]) if o["act"] and acts else 0
                if d <= 15 + 120 * max(0, dt) and extra <= 45:
                    costs[c, k] = d + 0.35 * extra
        out, taken = {}, {}
        while costs:
            c, k = min(costs, key=lambda p: (costs[p], p))
            taken[c] = k
            costs = {p: v for p, v in costs.items() if p[0] != c and p[1] != k}
        for k in range(len(self.seen)):
            if k not in taken.values():
                self.seen[k] = (self.seen[k] + [None])[-6:]
        for c, o in enumerate(obs):
            k = taken.get(c)
            if k is None:
                if not o["hit"]:
                    out[c] = (None, "below_threshold", 0, 0, False)
                    continue
                self.n += 1
                k = len(self.ids)
                self.ids.append(f"{site}-{datetime.fromtimestamp(at, timezone.utc):%Y%m%d%H%M%S}-T{self.n:04d}")
                self.seen.append([])
                self.confirmed.append(False)
            self.seen[k] = (self.seen[k] + [o])[-6:]
            last = self.seen[k][-3:]
            hits = sum(1 for x in last if x and x["hit"])
            new = hits >= 2 and not self.confirmed[k]
            self.confirmed[k] |= new
            out[c] = (self.ids[k], "newly_confirmed" if new else "confirmed" if self.confirmed[k] else "pending" if o["hit"] else "tracked_below_threshold", hits, len(last), new)
        keep = [k for k in range(len(self.ids)) if self.seen[k][-3:] != [None] * 3]
        self.ids, self.seen, self.confirmed = ([x[k] for k in keep] for x in (self.ids, self.seen, self.confirmed))
        return [out[c] for c in range(len(obs))]


def candidate(i, p, az, km, act=(None, None)):
    return dict(cand_idx=i, cell_id=f"c{i}", probability=p, threshold=0.6, az_deg=az, range_km=km, activation_az_deg=act[0], activation_range_km=act[1], quality_pass=True, reasons=[])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_rule_equals_oracle(seed):
    rng = random.Random(seed)
    state, oracle, at = {"tracks": [], "counter": 0}, Oracle(), 1.7e9
    for _ in range(12):
        at += rng.choice([300, 300, 300, 0, -300, 900])
        cands = [candidate(i, rng.choice([0.3, 0.6, 0.9]), rng.randrange(0, 360, 15), rng.choice([40.0, 50.0, 60.0]), rng.choice([(None, None), (rng.randrange(0, 360, 15), 50.0)])) for i in range(rng.randrange(0, 6))]
        got = tracker.advance(state, "A", at, cands, CONFIG)
        assert [(u["track_id"], u["status"], u["hits_in_window"], u["window_size"], u["newly_confirmed"]) for u in got] == oracle.feed("A", at, cands)
        assert all(len(t["observations"]) <= 6 for t in state["tracks"])
        ids = [u["track_id"] for u in got if u["track_id"]]
        assert len(ids) == len(set(ids))


def run(*scans):
    state, out = {"tracks": [], "counter": 0}, []
    for k, cands in enumerate(scans):
        out.append(tracker.advance(state, "A", 1.7e9 + 300 * k, cands, CONFIG))
    return out, state


def test_empty_scans_age_tracks():
    hit = [candidate(0, 0.9, 10, 60)]
    out, state = run(hit, [], hit)
    assert out[2][0]["status"] == "newly_confirmed"
    out, state = run(hit, [], [], hit)
    assert out[3][0]["status"] == "pending" and len(state["tracks"]) == 1  # two misses: found again, window too short
    out, state = run(hit, [], [], [])
    assert state["tracks"] == []


def test_reach_counts_as_match_and_below_threshold_extends_only():
    out, _ = run([candidate(0, 0.9, 0, 60)], [candidate(0, 0.2, 0, 85.0)])
    assert out[1][0]["status"] == "tracked_below_threshold"  # 25 km is just within 15 + 120 / 12
    out, state = run([candidate(0, 0.2, 0, 60)])
    assert out[0][0]["status"] == "below_threshold" and not state["tracks"]


def test_batch_over_nulls_and_empty_scans(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("A", t0, [candidate(0, 0.9, 10.0, 60.0)]), ("A", t0 + timedelta(minutes=5), []), ("A", t0 + timedelta(minutes=10), [candidate(0, 0.9, 10.0, 60.0), candidate(1, 0.9, None, 60.0)]), ("B", t0, None)]
    got = tracker.replay(spark.createDataFrame(rows, SCANS), CONFIG).orderBy("scan_time", "cand_idx").collect()
    assert [r["status"] for r in got] == ["pending", "newly_confirmed", "pending"]
    assert tracker.replay(spark.createDataFrame([], SCANS), CONFIG).count() == 0
    tracks = tracker.tracks_of(tracker.replay(spark.createDataFrame(rows, SCANS), CONFIG))
    assert tracks.count() == 2


def test_stream_equals_batch(spark):
    columns = ["site", "scan_time", "cand_idx", "cell_id", "track_id", "status", "hits_in_window", "window_size", "newly_confirmed"]
    batch = radar_queries.tracker_replay(spark, SMALL).select(*columns).toPandas()
    stream = stream_queries.stream_tracker(spark, SMALL).select(*columns).toPandas()
    assert normal(batch) == normal(stream) and len(batch) == 1000


def test_schedule_stream_equals_batch(spark):
    assert normal(radar_queries.activity_state(spark, SMALL).toPandas()) == normal(stream_queries.stream_schedule(spark, SMALL).toPandas())


def test_config_is_checked():
    with pytest.raises(ValueError):
        EngineConfig(track_confirm_scans=3, track_confirm_window_scans=2)
    assert EngineConfig.from_env({"GALEWATCH_TRACK_CONFIRM_SCANS": "1", "GALEWATCH_INCLUDE_TDWR": "1"}).track_confirm_scans == 1
