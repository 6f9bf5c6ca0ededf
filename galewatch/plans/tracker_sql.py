"""The tracking rules as one recursive SQL query over each site's scans in turn: a second, independent statement of them.

A step takes a site's open tracks and its next scan. Its lists are built up one after the other: where each track leads,
the costs of all pairs, the greedy choice among them, the tracks after the scan, and an update for each candidate.
"""

from __future__ import annotations

from galewatch.plans.views import CAND, EPOCH

OBS = "STRUCT(tm BIGINT, p DOUBLE, above BOOLEAN, x DOUBLE, y DOUBLE, ax DOUBLE, ay DOUBLE, missed BOOLEAN)"
TRACK = f"STRUCT(id VARCHAR, created BIGINT, confirmed BIGINT, obs {OBS}[])"
UPDATE = "STRUCT(c BIGINT, id VARCHAR, track VARCHAR, status VARCHAR, hits BIGINT, win BIGINT, fresh BOOLEAN, created BIGINT, confirmed BIGINT, n BIGINT, most DOUBLE, most_real DOUBLE)"

_seen = "{'tm': tm, 'p': cands[%s].p, 'above': cands[%s].above, 'x': cands[%s].x, 'y': cands[%s].y, 'ax': cands[%s].ax, 'ay': cands[%s].ay, 'missed': false}"
_miss = "{'tm': tm, 'p': 0.0::DOUBLE, 'above': false, 'x': NULL::DOUBLE, 'y': NULL::DOUBLE, 'ax': NULL::DOUBLE, 'ay': NULL::DOUBLE, 'missed': true}"


def seen(i: str) -> str:
    return _seen % ((i,) * 6)


def last(items: str, n: int) -> str:
    return f"list_slice({items}, greatest(len({items}) - {n - 1}, 1), len({items}))"


#: What a scan does to a site's tracks, step by step. Each step is columns over those of the steps before it.
STEPS = (
    # Last and last but one place of each track, and its last peak.
    f"""list_transform(own, lambda r: {{'n': len(r.real), 'a': r.real[len(r.real)], 'b': r.real[greatest(len(r.real) - 1, 1)], 'l': r.lit[len(r.lit)]}}) AS ends""",
    # Where each track leads: its last place, carried on by its last velocity.
    f"""list_transform(ends, lambda e: {{'lx': e.l.ax, 'ly': e.l.ay, 'reach': 15.0::DOUBLE + 120.0::DOUBLE * greatest(0.0::DOUBLE, (tm - e.a.tm) / 3600.0::DOUBLE),
    'x': CASE WHEN e.n > 1 AND tm > e.a.tm AND e.a.tm > e.b.tm THEN e.a.x + (e.a.x - e.b.x) / ((e.a.tm - e.b.tm) / 3600.0::DOUBLE) * ((tm - e.a.tm) / 3600.0::DOUBLE) ELSE e.a.x END,
    'y': CASE WHEN e.n > 1 AND tm > e.a.tm AND e.a.tm > e.b.tm THEN e.a.y + (e.a.y - e.b.y) / ((e.a.tm - e.b.tm) / 3600.0::DOUBLE) * ((tm - e.a.tm) / 3600.0::DOUBLE) ELSE e.a.y END}}) AS lead""",
    # Distances of every candidate from where every track leads.
    f"""flatten(list_transform(range(1, len(lead) + 1), lambda k: list_transform(range(1, len(cands) + 1), lambda i: {{'c': i, 't': k, 'reach': lead[k].reach,
    'd': sqrt((cands[i].x - lead[k].x) * (cands[i].x - lead[k].x) + (cands[i].y - lead[k].y) * (cands[i].y - lead[k].y)),
    'apart': sqrt((cands[i].ax - lead[k].lx) * (cands[i].ax - lead[k].lx) + (cands[i].ay - lead[k].ly) * (cands[i].ay - lead[k].ly))}}))) AS near""",
    # Costs of pairs within reach, none beyond.
    f"""list_transform(near, lambda q: {{'cost': CASE WHEN q.d <= q.reach AND coalesce(q.apart <= 45.0::DOUBLE, true) THEN q.d + 0.35::DOUBLE * coalesce(q.apart, 0.0::DOUBLE) END, 'c': q.c, 't': q.t}}) AS costs""",
    # Pairs in reach, by cost.
    f"""list_transform(list_sort(list_filter(costs, lambda q: q.cost IS NOT NULL)), lambda q: {{'cs': [q.c], 'ts': [q.t]}}) AS pairs""",
    # The greedy choice: pairs by least cost, each candidate and track once.
    f"""CASE WHEN len(pairs) = 0 THEN {{'cs': CAST([] AS BIGINT[]), 'ts': CAST([] AS BIGINT[])}} ELSE list_reduce(pairs, lambda a, b: CASE WHEN list_has_any(a.cs, b.cs) OR list_has_any(a.ts, b.ts) THEN a ELSE {{'cs': list_concat(a.cs, b.cs), 'ts': list_concat(a.ts, b.ts)}} END) END AS m""",
    # Candidates that start tracks, and old tracks with what they saw or a miss.
    f"""list_filter(range(1, len(cands) + 1), lambda i: cands[i].above AND NOT list_contains(m.cs, i)) AS fresh,
  list_transform(range(1, len(tracks) + 1), lambda k: {{'id': tracks[k].id, 'created': tracks[k].created, 'confirmed': tracks[k].confirmed, 'met': list_contains(m.ts, k),
    'obs': list_append(tracks[k].obs, CASE WHEN list_contains(m.ts, k) THEN {seen("m.cs[list_position(m.ts, k)]")} ELSE {_miss} END)}}) AS tracks1""",
    # Old tracks cut to their history, then those that start.
    f"""list_concat(list_transform(tracks1, lambda t: {{'id': t.id, 'created': t.created, 'confirmed': t.confirmed, 'obs': {last("t.obs", 6)}, 'met': t.met}}),
  list_transform(fresh, lambda i: {{'id': site || '-' || strftime(TIMESTAMP '1970-01-01' + to_seconds(tm), '%Y%m%d%H%M%S') || printf('-T%04d', counter + list_position(fresh, i)), 'created': tm, 'confirmed': CAST(NULL AS BIGINT), 'obs': [{seen("i")}], 'met': true}})) AS tracks2""",
    # Hits in the window of each track.
    f"""list_transform(tracks2, lambda t: {{'id': t.id, 'created': t.created, 'confirmed': t.confirmed, 'obs': t.obs, 'met': t.met, 'hits': len(list_filter({last("t.obs", 3)}, lambda o: o.above))}}) AS tracks3""",
    # Which tracks are confirmed by this scan, and whose candidate each one is.
    f"""list_transform(tracks3, lambda t: {{'id': t.id, 'created': t.created, 'obs': t.obs, 'hits': t.hits, 'fresh': t.met AND t.confirmed IS NULL AND t.hits >= 2, 'confirmed': CASE WHEN t.met AND t.confirmed IS NULL AND t.hits >= 2 THEN tm ELSE t.confirmed END}}) AS tracks4,
  list_transform(range(1, len(cands) + 1), lambda i: {{'i': i, 'k': CASE WHEN list_contains(m.cs, i) THEN m.ts[list_position(m.cs, i)] WHEN list_contains(fresh, i) THEN len(tracks) + list_position(fresh, i) END}}) AS whose""",
)


def nested(source: str, steps: tuple[str, ...]) -> str:
    for columns in steps:
        source = f"(SELECT *, {columns}\nFROM {source})"
    return source


#: A site's open tracks beside its next scan.
NEXT_SCAN = f"""(SELECT scan.site, scan.n, scan.tm, scan.cands, run.tracks, run.counter, list_transform(run.tracks, lambda t: {{'real': list_filter(t.obs, lambda o: NOT o.missed), 'lit': list_filter(t.obs, lambda o: NOT o.missed AND o.ax IS NOT NULL)}}) AS own
  FROM run JOIN scan ON scan.site = run.site AND scan.n = run.n + 1)"""
#: The state after a scan: tracks without too many misses, the counter of ids, and an update for each candidate.
AFTER = f"""list_transform(list_filter(tracks4, lambda t: len(list_filter({last("t.obs", 3)}, lambda o: o.missed)) < 3), lambda t: CAST({{'id': t.id, 'created': t.created, 'confirmed': t.confirmed, 'obs': t.obs}} AS {TRACK})) AS tracks,
  counter + len(fresh) AS counter,
  list_transform(whose, lambda w: CAST({{'c': cands[w.i].c, 'id': cands[w.i].id, 'track': tracks4[w.k].id,
    'status': CASE WHEN w.k IS NULL THEN 'below_threshold' WHEN tracks4[w.k].fresh THEN 'newly_confirmed' WHEN tracks4[w.k].confirmed IS NOT NULL THEN 'confirmed' WHEN cands[w.i].above THEN 'pending' ELSE 'tracked_below_threshold' END,
    'hits': coalesce(tracks4[w.k].hits, 0), 'win': CASE WHEN w.k IS NULL THEN 0 ELSE least(3, len(tracks4[w.k].obs)) END, 'fresh': coalesce(tracks4[w.k].fresh, false), 'created': tracks4[w.k].created, 'confirmed': tracks4[w.k].confirmed,
    'n': len(list_filter(tracks4[w.k].obs, lambda o: NOT o.missed)), 'most': list_max(list_transform(tracks4[w.k].obs, lambda o: o.p)), 'most_real': list_max(list_transform(list_filter(tracks4[w.k].obs, lambda o: NOT o.missed), lambda o: o.p))}} AS {UPDATE})) AS upd"""

TRACKER = f"""{CAND},
ranked AS (SELECT *, row_number() OVER (PARTITION BY site, scan_no ORDER BY dbz_max DESC, event_id) - 1 AS c, range_km * sin(radians(az_deg)) AS x, range_km * cos(radians(az_deg)) AS y,
  activation_range_km * sin(radians(activation_az_deg)) AS ax, activation_range_km * cos(radians(activation_az_deg)) AS ay FROM cand),
scan AS (SELECT site, scan_no * 300 + {EPOCH} AS tm, row_number() OVER (PARTITION BY site ORDER BY scan_no) AS n,
  list({{'c': c, 'id': CAST(event_id AS VARCHAR), 'p': probability, 'above': probability >= 0.6::DOUBLE, 'x': x, 'y': y, 'ax': ax, 'ay': ay}} ORDER BY c) AS cands FROM ranked GROUP BY site, scan_no),
run AS (SELECT site, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS tm, CAST([] AS {TRACK}[]) AS tracks, CAST(0 AS BIGINT) AS counter, CAST([] AS {UPDATE}[]) AS upd FROM (SELECT DISTINCT site FROM scan)
UNION ALL SELECT site, n, tm,
{AFTER}
FROM {nested(NEXT_SCAN, STEPS)}),
updates AS (SELECT site, tm, u.* FROM (SELECT site, tm, unnest(upd) AS u FROM run))"""


def stamp(column: str) -> str:
    return f"strftime(TIMESTAMP '1970-01-01' + to_seconds({column}), '%Y-%m-%dT%H:%M:%S+00:00')"


UPDATES_SQL = f"""WITH RECURSIVE {TRACKER} SELECT site, {stamp("tm")} AS scan_time, CAST(c AS INTEGER) AS cand_idx, id AS cell_id, track AS track_id, status, CAST(hits AS INTEGER) AS hits_in_window, CAST(win AS INTEGER) AS window_size, fresh AS newly_confirmed"""
REPLAY_SQL = f"{UPDATES_SQL}, round(most, 6) AS max_probability FROM updates"
STREAM_SQL = f"{UPDATES_SQL} FROM updates"
DETECTIONS_SQL = f"""WITH RECURSIVE {TRACKER}, q AS (SELECT *, concat_ws('; ', CASE WHEN range_km < 40.0::DOUBLE THEN printf('range %.1fkm < 40.0km', range_km) END, CASE WHEN n_gates < 100 THEN printf('n_gates %d < 100', n_gates) END,
  CASE WHEN edge_margin < 0.1::DOUBLE THEN printf('heatmap edge margin %.3f < 0.100', edge_margin) END) AS why FROM cand)
SELECT {stamp("confirmed")} AS confirmed_at, u.site, track AS track_id, {stamp("created")} AS first_seen, {stamp("tm")} AS latest_scan_time, id AS cell_id, CAST(hits AS INTEGER) AS hits_in_window, CAST(win AS INTEGER) AS confirmation_window, CAST(u.n AS INTEGER) AS observations,
  az_deg, range_km, dbz_max, n_gates, 0.0::DOUBLE AS shear, probability >= 0.6::DOUBLE AND why = '' AS quality_pass, CASE WHEN probability >= 0.6::DOUBLE THEN why ELSE '' END AS quality_reasons, activation_az_deg, activation_range_km,
  round_even(edge_margin, 4) AS heatmap_edge_margin, floor(probability * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS probability, floor(most_real * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS max_probability FROM updates u JOIN q ON q.event_id = CAST(u.id AS BIGINT) WHERE fresh"""
#: Open tracks after each site's last scan. Observations carry no cell id here: the cell is that of the track's last update.
OPEN_SQL = f"""WITH RECURSIVE {TRACKER},
ends AS (SELECT site, max(n) AS n FROM run GROUP BY site),
kept AS (SELECT run.site, unnest(run.tracks) AS t FROM run JOIN ends ON run.site = ends.site AND run.n = ends.n),
named AS (SELECT track, arg_max(id, tm) AS cell FROM updates WHERE track IS NOT NULL GROUP BY track),
flat AS (SELECT site, t.id AS id, t.created AS created, t.confirmed AS confirmed, t.obs AS obs, list_filter(t.obs, lambda o: NOT o.missed) AS real FROM kept)
SELECT site, flat.id AS track_id, {stamp("created")} AS created_at, {stamp("confirmed")} AS confirmed_at, CAST(len(obs) AS INTEGER) AS observations, CAST(len(obs) - len(real) AS INTEGER) AS missed, cell AS last_cell,
  round_even(real[len(real)].x, 6) AS x_km, round_even(real[len(real)].y, 6) AS y_km FROM flat JOIN named ON named.track = flat.id"""
