"""The greedy choice among pairs of candidates and tracks: by least cost, each of both once.

Pairs are met in rounds of growing cost. A round looks only at what is still free, and finds near pairs by a grid, so work
follows those that match near by, not all pairs of a scan; memory is bounded by ROOM pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs that are held at once, and pairs up to which a scan is matched in one round.
ROOM, FEW = 1 << 20, 1 << 14


def _apart(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.hypot(x - u, y - v)


def _near(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (c, t) of points (x, y) and (u, v), in blocks of some ROOM: all pairs within the radius, and others."""
    if len(x) * len(u) <= FEW or not radius < np.inf:
        low, high = np.zeros((1, len(u)), dtype=np.int64), np.full((1, len(u)), len(x))
        order = np.arange(len(x))
    else:
        size = max(radius, 1e-6) * (1 + 1e-6)
        ix, iy = (np.floor((a - a.min()) / size).astype(np.int64) + 2 for a in (x, y))
        jx, jy = (np.clip(np.floor((b - a.min()) / size), -2, top.max() + 2).astype(np.int64) + 2 for a, b, top in ((x, u, ix), (y, v, iy)))
        wide = int(ix.max()) + 4
        keys = iy * wide + ix
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        rows = np.stack([(jy + k) * wide + jx for k in (-1, 0, 1)])
        low, high = np.searchsorted(keys, rows - 1, "left"), np.searchsorted(keys, rows + 1, "right")
    low, n = low.ravel(), (high - low).ravel()
    track = np.tile(np.arange(len(u)), len(n) // len(u))
    ends = np.cumsum(n)
    first = 0
    while first < len(n):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + ROOM, "right")))
        own = n[first:last]
        t = np.repeat(track[first:last], own)
        inside = np.arange(len(t)) - np.repeat(ends[first:last] - own - before, own)
        yield order[np.repeat(low[first:last], own) + inside], t
        first = last


def _least(cost: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((t, c, cost))[:ROOM]
    return cost[order], c[order], t[order]


def _pairs(seen: dict, tracks: dict, limit: float, most: float, weight: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Feasible pairs of at most that cost, by cost, candidate and track: all, or the first ROOM of them."""
    cost, c, t, cut, all_of_them = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), limit, True
    for i, j in _near(seen["x"], seen["y"], tracks["x"], tracks["y"], limit):
        d = _apart(seen["x"][i], seen["y"][i], tracks["x"][j], tracks["y"][j])
        ok = (d <= tracks["reach"][j]) & (d <= cut)
        i, j, d = i[ok], j[ok], d[ok]
        a = _apart(seen["ax"][i], seen["ay"][i], tracks["ax"][j], tracks["ay"][j])  # NaN where either has no peak
        d = d + weight * np.where(np.isnan(a), 0.0, a)
        ok = ~(a > most) & (d <= cut)
        cost, c, t = np.concatenate([cost, d[ok]]), np.concatenate([c, i[ok]]), np.concatenate([t, j[ok]])
        if len(cost) > 2 * ROOM:
            cost, c, t = _least(cost, c, t)
            cut, all_of_them = cost[-1], False
    all_of_them &= len(cost) <= ROOM
    _, c, t = _least(cost, c, t)
    return c, t, all_of_them


def greedy(seen: dict[str, np.ndarray], tracks: dict[str, np.ndarray], most: float, weight: float) -> np.ndarray:
    """For each candidate its track, or -1.

    seen: x, y and the peak's ax, ay; tracks: where they lead (x, y), reach, and their last peak ax, ay. NaN: no place, or
    no peak. A pair is feasible within the reach and, where both have a peak, with peaks up to `most` apart; its cost is
    the distance and `weight` times that of the peaks. Equal costs go by candidate, then by track.
    """
    chosen = np.full(len(seen["x"]), -1, dtype=np.int64)
    cs, ts = np.flatnonzero(~np.isnan(seen["x"])), np.flatnonzero(~np.isnan(tracks["x"]))
    if not len(cs) or not len(ts):
        return chosen
    far = float(tracks["reach"][ts].max())
    limit = np.inf if len(cs) * len(ts) <= FEW else far / np.sqrt(min(len(cs), len(ts)))
    while len(cs) and len(ts):
        c, t, done = _pairs({k: v[cs] for k, v in seen.items()}, {k: v[ts] for k, v in tracks.items()}, limit, most, weight)
        free_c, free_t = bytearray(b"\1") * len(cs), bytearray(b"\1") * len(ts)
        for i, j in zip(c.tolist(), t.tolist()):
            if free_c[i] and free_t[j]:
                free_c[i] = free_t[j] = 0
                chosen[cs[i]] = ts[j]
        cs, ts = cs[np.frombuffer(free_c, dtype=bool)], ts[np.frombuffer(free_t, dtype=bool)]
        if done and limit >= far + weight * most:
            break
        if done:
            limit *= 2.0
    return chosen
