"""Scans with many candidates: the greedy choice in rounds against all pairs, and work that follows what is near."""

import time

import numpy as np
import pytest

from galewatch.config import EngineConfig
from galewatch.streaming import matching, tracker

CONFIG = EngineConfig()


def scan(rng, n, coarse):
    """n candidates on a lattice, so that many costs are equal, a few of them without a place."""
    az, km = rng.integers(0, 360 // coarse, n) * float(coarse), rng.integers(12, 212, n).astype(float)
    lit, placed = rng.random(n) < 0.8, rng.random(n) < 0.98
    return [
        dict(cand_idx=i, cell_id=f"c{i}", probability=float(rng.random()), threshold=0.6, az_deg=float(az[i]) if placed[i] else None, range_km=float(km[i]), activation_az_deg=float(az[i]) + 1 if lit[i] else None, activation_range_km=float(km[i]) + 3 if lit[i] else None, quality_pass=None, reasons=None)
        for i in range(n)
    ]


def brute(seen, tracks, most, weight):
    d = np.hypot(seen["x"][:, None] - tracks["x"], seen["y"][:, None] - tracks["y"])
    a = np.hypot(seen["ax"][:, None] - tracks["ax"], seen["ay"][:, None] - tracks["ay"])
    cost = np.where((d <= tracks["reach"]) & ~(a > most), d + weight * np.where(np.isnan(a), 0.0, a), np.nan)
    chosen, taken = np.full(len(seen["x"]), -1), set()
    for _, c, t in sorted((cost[c, t], c, t) for c, t in zip(*np.nonzero(~np.isnan(cost)))):
        if chosen[c] < 0 and t not in taken:
            chosen[c] = t
            taken.add(t)
    return chosen


@pytest.mark.parametrize("room", [1 << 20, 1 << 10])
@pytest.mark.parametrize("crowded", [False, True])
def test_rounds_choose_as_all_pairs_do(monkeypatch, room, crowded):
    monkeypatch.setattr(matching, "ROOM", room)
    rng = np.random.default_rng(1)

    def points(n, void):
        x, y = (rng.choice([10.0, 14.0, 18.0], n) if crowded else rng.integers(-60, 60, n).astype(float) for _ in range(2))
        gone = rng.random(n) < void
        dark = rng.random(n) < 0.2
        return {"x": np.where(gone, np.nan, x), "y": np.where(gone, np.nan, y), "ax": np.where(dark, np.nan, x + rng.integers(-30, 30, n)), "ay": np.where(dark, np.nan, y)}

    seen, tracks = points(400, 0.02), points(300, 0.02)
    tracks["reach"] = rng.choice([5.0, 25.0], 300)
    tracks["x"][0] += 1e9  # a track that leads far away
    assert matching.greedy(seen, tracks, 45.0, 0.35).tolist() == brute(seen, tracks, 45.0, 0.35).tolist()


def test_work_follows_candidates_not_their_pairs():
    rng = np.random.default_rng(2)
    state, began = {"tracks": [], "counter": 0}, time.process_time()
    for k in range(4):
        updates = tracker.advance(state, "A", 1.7e9 + 300 * k, scan(rng, 6000, 1), CONFIG)
    assert len(updates) == 6000 and sum(u["status"] == "confirmed" for u in updates) > 1000
    assert time.process_time() - began < 15  # some 60 million pairs of candidates and tracks


def test_stream_writes_no_history_where_none_is_asked(spark, monkeypatch):
    from conftest import SMALL

    from galewatch.plans import stream_queries

    columns = []
    for name in ("finished", "fed"):
        made = getattr(stream_queries, name)
        monkeypatch.setattr(stream_queries, name, lambda s, rows, make, made=made: made(s, rows, lambda x: (out := make(x), columns.append(out.columns))[0]))
    stream_queries.stream_tracker(spark, SMALL)
    stream_queries.saved_open_tracks(spark, SMALL)
    assert len(columns) == 3 and not any("observations" in c for c in columns)


def test_tracks_in_a_state_store_go_on_as_those_in_memory():
    import json

    rng = np.random.default_rng(3)
    scans = [scan(rng, n, 15) for n in (300, 200, 0, 300, 250, 0, 0, 300, 200)]
    held, kept = tracker.OpenTracks(CONFIG), {"tracks": [], "counter": 0}
    for k, own in enumerate(scans):
        columns = {f: tracker._numbers(c[f] for c in own) if f in tracker.NUMBERS else tracker.objects(c[f] for c in own) for f in tracker.CANDIDATE_FIELDS}
        a = held.feed("A", 1.7e9 + 300 * k, columns)
        b = tracker.advance(kept, "A", 1.7e9 + 300 * k, own, CONFIG)
        kept = json.loads(json.dumps(kept))
        assert a["track_id"].tolist() == [u["track_id"] for u in b] and a["status"].tolist() == [u["status"] for u in b]
    assert json.loads(json.dumps(held.told())) == kept["tracks"] and len(kept["tracks"]) > 100
