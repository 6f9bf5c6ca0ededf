"""Queries over summaries, map datasets, schedules, chips and exports, each with the SQL that must give the same rows."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewatch.config import EngineConfig
from galewatch.functions import geo, phase, text
from galewatch.functions.tables import shared_dir
from galewatch.operators import cells, chips, history, quality, scoring
from galewatch.plans import engine, reports
from galewatch.plans.radar_queries import CONFIG, HIST, SITED, _activity_sql, _histories, _rays, _track_table, placed_sql, query, six
from galewatch.plans.views import CAND, SITE_DIM, SWEEP_GATES, attempts, candidates, read, site_dim, sweep_gates
from galewatch.schemas import FIELDS
from galewatch.sources import sites as site_source
from galewatch.sources import volumes
from galewatch.streaming import schedule, sinks

# --- summaries --------------------------------------------------------------------------------------------------------

UPD = """upd AS (SELECT *, ['pending', 'confirmed', 'newly_confirmed', 'tracked_below_threshold'][event_id % 5 + 1] AS status FROM cand)"""
PER_SCAN = f"""{CAND}, {UPD}, seen AS (SELECT site, scan_time, count(*) AS n_cells, count(*) FILTER (probability >= 0.6::DOUBLE) AS n_raw, count(*) FILTER (status = 'pending') AS n_pending,
  count(*) FILTER (status IN ('confirmed', 'newly_confirmed')) AS n_confirmed, count(*) FILTER (status = 'newly_confirmed') AS n_newly_confirmed, max(probability) AS max_prob FROM upd GROUP BY 1, 2),
every AS (SELECT DISTINCT site, scan_time FROM cand UNION SELECT DISTINCT site, TIMESTAMP '2024-06-01' FROM cand),
per_scan AS (SELECT e.site, e.scan_time, coalesce(n_cells, 0) AS n_cells, coalesce(n_raw, 0) AS n_raw, coalesce(n_pending, 0) AS n_pending, coalesce(n_confirmed, 0) AS n_confirmed, coalesce(n_newly_confirmed, 0) AS n_newly_confirmed, coalesce(max_prob, 0.0::DOUBLE) AS max_prob
  FROM every e LEFT JOIN seen s ON e.site = s.site AND e.scan_time = s.scan_time)"""


def _updates(c: DataFrame) -> DataFrame:
    """Every event but each fifth as a tracking update."""
    status = F.get(F.array(*map(F.lit, ("pending", "confirmed", "newly_confirmed", "tracked_below_threshold"))), (F.col("event_id") % 5).cast("int"))
    rows = c.select("site", "scan_time", F.col("event_id").alias("cand_idx"), status.alias("status")).where(F.col("status").isNotNull())
    return rows.withColumn("newly_confirmed", F.col("status") == "newly_confirmed")


def _per_scan(spark, sf_dir) -> DataFrame:
    c = quality.evaluate(candidates(spark, sf_dir), CONFIG).withColumn("cand_idx", F.col("event_id"))
    scans = c.select("site", "scan_time").unionByName(c.select("site", F.lit("2024-06-01").cast("timestamp").alias("scan_time")))
    return reports.scan_summary(c, _updates(c), scans)


@query(f"WITH {PER_SCAN} SELECT * REPLACE (strftime(scan_time, '%Y-%m-%dT%H:%M:%S+00:00') AS scan_time), CASE WHEN n_newly_confirmed > 0 THEN 'new' WHEN n_confirmed > 0 THEN 'confirmed' WHEN n_raw > 0 THEN 'raw' ELSE 'plain' END AS row_class FROM per_scan")
def scan_status_counts(spark, sf_dir):
    return _per_scan(spark, sf_dir).withColumn("row_class", reports.highlight("scans")).withColumn("scan_time", text.iso_utc(F.col("scan_time")))


@query(f"""WITH {PER_SCAN}, {HIST} SELECT (SELECT count(*) FROM per_scan) AS scans, (SELECT CAST(sum(n_raw) AS BIGINT) FROM per_scan) AS raw_hits, count(*) AS tracks, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (is_valid) AS valid,
  count(*) FILTER (is_active) AS active, count(*) FILTER (is_valid AND NOT is_active) AS stale FROM s""")
def replay_totals(spark, sf_dir):
    return reports.replay_summary(_per_scan(spark, sf_dir), _track_table(spark, sf_dir))


@query(f"""WITH {CAND}, {UPD}, v AS (SELECT DISTINCT site, scan_no, scan_time FROM cand),
f AS (SELECT site, scan_no, count(*) AS n FROM cand WHERE scan_no % 7 <> 0 GROUP BY 1, 2), h AS (SELECT site, scan_no, count(*) AS n, count(*) FILTER (probability >= 0.6::DOUBLE) AS raw FROM cand WHERE scan_no % 5 <> 1 GROUP BY 1, 2),
u AS (SELECT site, scan_no, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'newly_confirmed') AS new FROM upd WHERE status IS NOT NULL GROUP BY 1, 2),
o AS (SELECT v.site, v.scan_no, v.site || '-' || strftime(v.scan_time, '%Y%m%d%H%M%S') AS scan_key, CAST(coalesce(f.n, 0) AS INTEGER) AS cells_found, CAST(coalesce(h.n, 0) AS INTEGER) AS chips_processed, CAST(coalesce(h.raw, 0) AS INTEGER) AS raw_detections,
  CAST(coalesce(u.pending, 0) AS INTEGER) AS pending_tracks, CAST(coalesce(u.new, 0) AS INTEGER) AS detections FROM v LEFT JOIN f USING (site, scan_no) LEFT JOIN h USING (site, scan_no) LEFT JOIN u USING (site, scan_no))
SELECT site, scan_key, cells_found, chips_processed, raw_detections, pending_tracks, detections, CASE WHEN cells_found = 0 THEN 'no_cells' WHEN chips_processed = 0 THEN 'no_chips' ELSE 'processed' END AS status,
  CASE WHEN scan_no % 11 = 3 THEN 'parse_error: bad header' WHEN cells_found = 0 THEN 'no_chips' WHEN chips_processed = 0 THEN 'no_valid_chips' ELSE 'processed' END AS replay_status FROM o""")
def scan_outcomes(spark, sf_dir):
    c = quality.evaluate(candidates(spark, sf_dir), CONFIG).withColumn("scan_key", text.scan_key(F.col("site"), F.col("scan_time")))
    own = c.select("site", "scan_key", "scan_time", "scan_no").distinct()
    out = engine.scan_outcomes(own, c.where(F.col("scan_no") % 7 != 0), c.where(F.col("scan_no") % 5 != 1), _updates(c))
    error = F.when(F.col("scan_no") % 11 == 3, "bad header")
    rows = out.join(own.select("scan_key", "scan_no"), "scan_key").withColumn("replay_status", reports.replay_status(F.col("cells_found"), F.col("chips_processed"), error))
    return rows.select("site", "scan_key", "cells_found", "chips_processed", "raw_detections", "pending_tracks", "detections", "status", "replay_status")


@query("""WITH t AS (SELECT CAST(user_id AS VARCHAR) AS scan_key, event_type AS stage, max(value) AS seconds FROM events GROUP BY 1, 2)
SELECT scan_key, stage, seconds, round(sum(seconds) OVER (PARTITION BY scan_key), 6) AS total, seconds = max(seconds) OVER (PARTITION BY scan_key) AS is_longest FROM t""")
def stage_times(spark, sf_dir):
    timings = read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("scan_key"), F.col("event_type").alias("stage")).agg(F.max("value").alias("seconds"))
    return reports.stage_times(timings).withColumn("total", six(F.col("total")))


# --- tracks -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {HIST}, {SITE_DIM}, p AS (SELECT CAST(user_id AS VARCHAR) AS track_id, ts, probability, 45.0::DOUBLE AS az, event_id * sqrt(2.0::DOUBLE) AS km, (SELECT lat FROM site_dim WHERE site_id = 'click') AS lat0, (SELECT lon FROM site_dim WHERE site_id = 'click') AS lon0, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, count(*) OVER (PARTITION BY user_id) AS n FROM k WHERE NOT missed), {placed_sql("p")}
SELECT track_id, CAST(step AS INTEGER) AS step, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS scan_time, probability, round(lat, 6) AS lat, round(lon, 6) AS lon, step = 0 AS is_start, step = n - 1 AS is_end FROM placed""")
def track_paths(spark, sf_dir):
    tracks = _histories(spark, sf_dir).withColumn("site", F.lit("click"))
    return reports.track_paths(tracks, site_dim(spark)).withColumn("scan_time", text.iso_utc(F.col("scan_time"))).drop("site").withColumns({c: six(F.col(c)) for c in ("lat", "lon")})


@query(f"WITH {HIST} SELECT CAST(user_id AS VARCHAR) AS track_id, count(*) FILTER (valid AND rn <= 3) >= 2 AS recent_valid FROM k GROUP BY user_id")
def recent_window(spark, sf_dir):
    return _histories(spark, sf_dir).select("track_id", history.recent_window_valid(F.col("observations"), 2, 3).alias("recent_valid"))


@query(f"""WITH {HIST}, p AS (SELECT user_id, ts, CAST(event_id AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM k WHERE NOT missed),
q AS (SELECT user_id, max(x) FILTER (back = 1) AS x1, max(x) FILTER (back = 2) AS x2, CAST(max(epoch_us(ts)) FILTER (back = 1) AS DOUBLE) / 3.6e9::DOUBLE AS t1, CAST(max(epoch_us(ts)) FILTER (back = 2) AS DOUBLE) / 3.6e9::DOUBLE AS t2 FROM p GROUP BY user_id)
SELECT CAST(u.user_id AS VARCHAR) AS track_id, round(CASE WHEN t1 - t2 > 0 THEN x1 + (x1 - x2) / (t1 - t2) * 2.0::DOUBLE ELSE x1 END, 3) AS x_km FROM (SELECT DISTINCT user_id FROM k) u LEFT JOIN q ON u.user_id = q.user_id""")
def predicted_places(spark, sf_dir):
    tracks = _histories(spark, sf_dir)
    last = F.try_element_at(history.located(F.col("observations")), F.lit(-1))["scan_time"]
    return tracks.select("track_id", F.round(history.predicted_xy(F.col("observations"), last + F.expr("INTERVAL 2 HOURS"))[0], 3).alias("x_km"))


# --- maps -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {CAND}, p AS (SELECT event_id, range_km * sin(radians(az_deg)) AS x, range_km * cos(radians(az_deg)) AS y FROM cand)
SELECT event_id, round(((degrees(atan2(x, y)) + 360.0::DOUBLE) % 360.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE, 6) AS az_deg, round(sqrt(x * x + y * y), 6) AS range_km FROM p""")
def bearing_back(spark, sf_dir):
    az, km = geo.xy_polar(*geo.polar_xy(F.col("az_deg"), F.col("range_km")))
    return candidates(spark, sf_dir).select("event_id", six(az).alias("az_deg"), six(km).alias("range_km"))


@query(f"""WITH {CAND}, q AS (SELECT *, probability >= 0.6::DOUBLE AS above, coalesce(concat_ws('; ', CASE WHEN range_km < 40.0::DOUBLE THEN 'range < 40 km' END, CASE WHEN n_gates < 100 THEN 'gates < 100' END, CASE WHEN edge_margin < 0.1::DOUBLE THEN 'edge max' END), '') AS why FROM cand)
SELECT event_id, printf('C%02d ', event_id) || CASE WHEN probability > 0 AND probability < 0.001::DOUBLE THEN printf('%.4f', probability) ELSE printf('%.3f', probability) END AS label,
  CASE WHEN above AND why = '' THEN 'actionable' WHEN above THEN 'gated' ELSE 'below' END AS marker_class, coalesce(edge_margin < 0.1::DOUBLE, false) AS near_edge, CASE WHEN above THEN why ELSE '' END AS gate_reasons FROM q""")
def cell_markers(spark, sf_dir):
    c = quality.evaluate(candidates(spark, sf_dir), CONFIG)
    c = c.withColumn("cell_id", text.cell_id(text.scan_key(F.col("site"), F.col("scan_time")), F.col("event_id")))
    return reports.cell_markers(c, CONFIG).select("event_id", "label", "marker_class", "near_edge", text.joined_reasons(F.col("gate_reasons")).alias("gate_reasons"))


@query(f"WITH {CAND} SELECT event_id, activation_az_deg IS NULL OR (activation_az_deg = az_deg AND activation_range_km = range_km) AS at_centroid FROM cand WHERE probability >= 0.6::DOUBLE")
def overlay_hits(spark, sf_dir):
    hits = reports.overlay_hits(quality.evaluate(candidates(spark, sf_dir), CONFIG), site_dim(spark))
    return hits.select("event_id", ((F.col("hit_lat") == F.col("lat")) & (F.col("hit_lon") == F.col("lon"))).alias("at_centroid"))


@query(f"""WITH {CAND}, d AS (SELECT *, CASE WHEN event_id % 4 <> 0 THEN probability >= 0.5::DOUBLE END AS above, CASE WHEN event_id % 4 > 1 THEN event_id % 2 = 0 END AS fine FROM cand)
SELECT event_id, coalesce(above, probability >= 0.7::DOUBLE) AS shown_above, coalesce(fine, above, probability >= 0.7::DOUBLE) AS shown_actionable,
  CASE WHEN probability >= 0.7::DOUBLE THEN concat_ws('; ', CASE WHEN range_km < 40.0::DOUBLE THEN printf('range %.1fkm < 40.0km', range_km) END, CASE WHEN n_gates < 100 THEN printf('n_gates %d < 100', n_gates) END, CASE WHEN edge_margin < 0.1::DOUBLE THEN printf('heatmap edge margin %.3f < 0.100', edge_margin) END) ELSE '' END AS reasons FROM d""")
def slider_decisions(spark, sf_dir):
    c = quality.evaluate(candidates(spark, sf_dir), CONFIG, 0.7)
    above = F.when(F.col("event_id") % 4 != 0, F.col("probability") >= 0.5)
    fine = F.when(F.col("event_id") % 4 > 1, F.col("event_id") % 2 == 0)
    shown = reports.decision_flags(F.col("probability"), F.lit(0.7), above, fine)
    return c.select("event_id", shown[0].alias("shown_above"), shown[1].alias("shown_actionable"), text.joined_reasons(F.col("reasons")).alias("reasons"))


@query("""WITH RECURSIVE r AS (SELECT c_nationkey AS nation, c_custkey, CAST(c_custkey % 97 AS DOUBLE) AS x, CAST(c_custkey % 13 AS DOUBLE) AS y, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
s AS (SELECT DISTINCT nation, CAST(0 AS BIGINT) AS rank, CAST([] AS STRUCT(rank BIGINT, x DOUBLE, y DOUBLE, k BIGINT)[]) AS kept FROM r
  UNION ALL SELECT r.nation, r.rank, CASE WHEN len(list_filter(s.kept, lambda q: abs(q.x - r.x) < 20.0::DOUBLE AND abs(q.y - r.y) < 4.0::DOUBLE)) > 0 THEN s.kept ELSE list_append(s.kept, {'rank': r.rank, 'x': r.x, 'y': r.y, 'k': CAST(r.c_custkey AS BIGINT)}) END
  FROM s JOIN r ON r.nation = s.nation AND r.rank = s.rank + 1 AND r.rank <= 30),
l AS (SELECT nation, arg_max(kept, rank) AS kept FROM s GROUP BY nation), u AS (SELECT nation, unnest(kept) AS p FROM l)
SELECT CAST(nation AS BIGINT) AS nation, CAST(p.rank AS INTEGER) AS rank, p.x AS x, p.y AS y, CAST(p.k AS VARCHAR) AS name FROM u""")
def spaced_labels(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), (k % 97).cast("double").alias("x"), (k % 13).cast("double").alias("y"), k.cast("string").alias("name"), "c_acctbal", "c_custkey")
    top = reports.top_labels(rows, ["nation"], [F.desc("c_acctbal"), F.col("c_custkey")], 30)  # as many labels as a map takes
    return reports.spaced_labels(top.withColumn("rank", F.col("label_rank")), "nation", 20.0, 4.0)


@query(f"""WITH {SWEEP_GATES}, f AS (SELECT DISTINCT sweep_id, CAST(200 + sweep_id % 150 AS DOUBLE) AS far FROM sweep_gates),
o AS (SELECT g.sweep_id, g.ray_idx * 10.0::DOUBLE AS az, g.gate_idx * 10.0::DOUBLE AS km, 35.0::DOUBLE AS lat0, -97.0::DOUBLE AS lon0, g.dbz AS value FROM sweep_gates g JOIN f ON g.sweep_id = f.sweep_id WHERE g.gate_idx * 10.0::DOUBLE <= greatest(300.0::DOUBLE, f.far + 40.0::DOUBLE)), {placed_sql("o")}
SELECT sweep_id, az AS azimuth_deg, km AS range_km, round(lat, 6) AS lat, round(lon, 6) AS lon, value FROM placed""")
def plot_gates(spark, sf_dir):
    rays = _rays(sweep_gates(spark, sf_dir)).withColumn("azimuth_deg", F.col("ray_idx") * 10.0)
    keys = rays.select("scan_key").distinct()
    own = keys.select("scan_key", F.lit(35.0).alias("lat"), F.lit(-97.0).alias("lon"), F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: i * 10000.0).alias("range_m"))
    far = keys.select("scan_key", (F.col("scan_key") % 150 + 200).cast("double").alias("range_km"))
    return reports.plot_gates(rays, own, far, "dbz").select(F.col("scan_key").alias("sweep_id"), "azimuth_deg", "range_km", six(F.col("lat")).alias("lat"), six(F.col("lon")).alias("lon"), "value")


# --- catalog and files ------------------------------------------------------------------------------------------------


@query(f"WITH {SITE_DIM} SELECT DISTINCT event_type || CASE WHEN user_id % 3 = 0 THEN '2' ELSE '' END AS site FROM events WHERE event_type || CASE WHEN user_id % 3 = 0 THEN '2' ELSE '' END NOT IN (SELECT site_id FROM site_dim)")
def unknown_sites(spark, sf_dir):
    asked = read(spark, sf_dir, "events").select(F.concat("event_type", F.when(F.col("user_id") % 3 == 0, "2").otherwise("")).alias("site")).distinct()
    return site_source.unknown_sites(asked, site_dim(spark))


@query("""WITH s AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS site_id, CAST(s_suppkey * 37 % 17000 AS DOUBLE) / 100.0::DOUBLE - 85.0::DOUBLE AS lat, CAST(s_suppkey * 53 % 36000 AS DOUBLE) / 100.0::DOUBLE - 180.0::DOUBLE AS lon, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT printf('%s%s%.5f%s%.5f%s%s', site_id, chr(9), lat, chr(9), lon, chr(9), n_name) AS line FROM s""")
def site_listing(spark, sf_dir):
    """Suppliers as sites, named after their nations."""
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.concat(F.lit("S"), k.cast("string")).alias("site_id"), ((k * 37 % 17000).cast("double") / 100.0 - 85.0).alias("lat"), ((k * 53 % 36000).cast("double") / 100.0 - 180.0).alias("lon"), F.col("n_name").alias("name"))
    return site_source.listing(rows)


@query(f"""WITH {CAND}, {SITE_DIM}, v AS (SELECT DISTINCT site, scan_no, CASE WHEN scan_no % 3 = 0 THEN 0.5 ELSE 41.0 END::DOUBLE AS lat, CASE WHEN scan_no % 2 = 0 THEN -0.25 ELSE -90.0 END::DOUBLE AS lon FROM cand)
SELECT v.site || '-' || CAST(scan_no AS VARCHAR) AS scan_key, CASE WHEN abs(v.lat) < 1.0 AND abs(v.lon) < 1.0 AND d.lat IS NOT NULL THEN d.lat ELSE v.lat END AS lat, CASE WHEN abs(v.lat) < 1.0 AND abs(v.lon) < 1.0 AND d.lat IS NOT NULL THEN d.lon ELSE v.lon END AS lon FROM v LEFT JOIN site_dim d ON d.site_id = v.site AND d.site_id <> 'view'""")
def volume_places(spark, sf_dir):
    c = candidates(spark, sf_dir).select("site", "scan_no").distinct()
    own = c.select("site", F.concat_ws("-", "site", "scan_no").alias("scan_key"), F.when(F.col("scan_no") % 3 == 0, 0.5).otherwise(41.0).alias("lat"), F.when(F.col("scan_no") % 2 == 0, -0.25).otherwise(-90.0).alias("lon"))
    return site_source.volume_coordinates(own, site_dim(spark).where("site_id <> 'view'")).drop("site")


NAMED = "named AS (SELECT event_id, upper(event_type) AS site, CAST(ts AS DATE) AS scan_date, substr(upper(event_type), 1, 4) || strftime(ts, '%Y%m%d_%H%M%S') || '_V06' AS filename FROM events)"


@query(f"WITH {NAMED} SELECT event_id, site, CAST(scan_date AS VARCHAR) AS scan_date, filename FROM named WHERE filename = (SELECT max(filename) FROM named)")
def scan_by_filename(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    name = F.concat(F.substring(F.upper("event_type"), 1, 4), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HHmmss"), F.lit("_V06"))
    catalog = e.select("event_id", F.upper("event_type").alias("site"), F.to_date("ts").alias("scan_date"), name.alias("filename"))
    last = catalog.agg(F.max("filename")).first()[0] or ""
    return volumes.scan_by_filename(catalog, last).withColumn("scan_date", F.col("scan_date").cast("string"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS scan_time FROM events")
def scan_times(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("seconds since "), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("units"))
    return e.select("event_id", text.iso_utc(text.scan_time_from_units(F.col("units"))).alias("scan_time"))


@query(f"""WITH {SITED}, {placed_sql("sited")} SELECT strftime(scan_time, '%Y-%m-%dT%H:%M:%S+00:00') AS scan_time, site, CAST(event_id AS VARCHAR) AS cell_id, az_deg, range_km, dbz_max, n_gates, round_even(lat, 5) AS lat, round_even(lon, 5) AS lon, CASE WHEN probability >= 0.6::DOUBLE THEN 'True' ELSE 'False' END AS above_threshold FROM placed""")
def results_csv(spark, sf_dir):
    """The results log, appended in two parts, exported as CSV and read back."""
    root = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    rows = quality.evaluate(candidates(spark, sf_dir), CONFIG).withColumn("cell_id", F.col("event_id").cast("string"))
    rows = sinks.results_table(rows, site_dim(spark))
    for part in (F.col("above_threshold") == "True", F.col("above_threshold") == "False"):
        sinks.append(rows.where(part), f"{root}/log", ["site"])
    sinks.export_csv(spark.read.parquet(f"{root}/log").select(*rows.columns), f"{root}/csv")
    return spark.read.schema(rows.schema).option("header", "true").csv(f"{root}/csv").drop("probability")  # results_export has it


# --- the schedule -----------------------------------------------------------------------------------------------------


@query(_activity_sql().replace("\nSELECT c.site, c.seq, c.status", ",\nsched AS (SELECT c.site, c.seq, c.status", 1) + f"""),
latest AS (SELECT site, arg_max(delay_seconds, seq) AS delay_seconds, arg_max(priority, seq) AS priority, max(seq) AS seq FROM sched GROUP BY site),
q AS (SELECT site, TIMESTAMP '2024-03-01' + to_seconds(CAST(seq % 1000 + delay_seconds AS BIGINT)) AS due_at, priority FROM latest UNION ALL SELECT 'never', TIMESTAMP '2024-03-01 00:15:00', 10)
SELECT site, strftime(due_at, '%Y-%m-%dT%H:%M:%S+00:00') AS due_at, CAST(priority AS INTEGER) AS priority, due_at <= TIMESTAMP '2024-03-01 00:15:00' AS due FROM q""")
def due_queue(spark, sf_dir):
    start = F.lit("2024-03-01").cast("timestamp")
    states = schedule.site_states(schedule.schedule(attempts(spark, sf_dir), CONFIG))
    states = states.withColumn("finished_at", F.timestamp_add("SECOND", F.col("seq") % 1000, start))
    known = site_dim(spark).select(F.col("site_id").alias("site"))
    sites = known.unionByName(spark.createDataFrame([("never",)], "site string"))
    return schedule.due_queue(states, sites, F.lit("2024-03-01 00:15:00").cast("timestamp")).withColumn("due_at", text.iso_utc(F.col("due_at")))


# --- cells, chips and scores ------------------------------------------------------------------------------------------

SMALL = EngineConfig(cell_min_gates=5, shear_threshold=0.25, chip_azimuth_bins=16, chip_range_gates=16, chip_range_m=16_000.0)


def _sweeps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """RAYS and VOLUMES of one sweep a scan, with all 36 rays of 40 gates a kilometre apart."""
    rays = _rays(sweep_gates(spark, sf_dir))
    blank = F.array_repeat(F.lit(None).cast("float"), 40)
    every = rays.select("scan_key").distinct().withColumn("ray_idx", F.explode(F.sequence(F.lit(0), F.lit(35))))
    fields = {"reflectivity": F.coalesce(F.col("dbz").cast("array<float>"), blank), "velocity": F.coalesce(F.col("vel").cast("array<float>"), blank)}
    rays = every.join(rays, ["scan_key", "ray_idx"], "left").select(
        F.lit("all").alias("site"), F.col("scan_key").cast("string").alias("scan_key"), F.lit(0).alias("sweep_idx"), "ray_idx", (F.col("ray_idx") * 10.0).alias("azimuth_deg"), F.lit(0.5).alias("elevation_deg"),
        *[fields.get(f, F.lit(None).cast("array<float>")).alias(f) for f in FIELDS],
    )
    own = rays.select("site", "scan_key").distinct().withColumn("range_m", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: i * 1000.0))
    return rays, own


@query(f"""WITH RECURSIVE {SWEEP_GATES}, g AS (SELECT sweep_id, ray_idx, gate_idx, dbz, ray_idx * 40 + gate_idx AS p FROM sweep_gates WHERE dbz >= 40.0::DOUBLE AND gate_idx >= 10),
e AS (SELECT a.sweep_id, a.p AS a, b.p AS b FROM g a JOIN g b ON a.sweep_id = b.sweep_id AND abs(a.ray_idx - b.ray_idx) + abs(a.gate_idx - b.gate_idx) = 1),
reach AS (SELECT sweep_id, p, p AS q FROM g UNION SELECT r.sweep_id, r.p, e.b FROM reach r JOIN e ON r.sweep_id = e.sweep_id AND r.q = e.a),
l AS (SELECT sweep_id, p, dense_rank() OVER (PARTITION BY sweep_id ORDER BY r) AS label FROM (SELECT sweep_id, p, min(q) AS r FROM reach GROUP BY 1, 2)),
c AS (SELECT g.sweep_id, l.label, count(*) AS n_gates, max(g.dbz) AS dbz_max, CAST(round_even(avg(g.ray_idx), 0) AS INTEGER) AS ray, CAST(round_even(avg(g.gate_idx), 0) AS INTEGER) AS gate FROM g JOIN l ON g.sweep_id = l.sweep_id AND g.p = l.p GROUP BY 1, 2 HAVING count(*) >= 5),
a AS (SELECT c.sweep_id, c.label, k.k, x.gate_idx, v.vel FROM c CROSS JOIN (SELECT unnest(range(-10, 11)) AS k) k CROSS JOIN (SELECT unnest(range(0, 40)) AS gate_idx) x
  LEFT JOIN sweep_gates v ON v.sweep_id = c.sweep_id AND v.ray_idx = (c.ray + k.k + 36) % 36 AND v.gate_idx = x.gate_idx WHERE x.gate_idx BETWEEN c.gate - 10 AND c.gate + 10),
d AS (SELECT sweep_id, label, abs(vel - lag(vel) OVER (PARTITION BY sweep_id, label, gate_idx ORDER BY k)) AS d FROM a), m AS (SELECT sweep_id, label, max(d) AS d FROM d GROUP BY 1, 2),
z AS (SELECT c.*, coalesce(m.d, 0.0::DOUBLE) / greatest(0.01::DOUBLE, CAST(gate AS DOUBLE) * radians(10.0::DOUBLE)) AS shear FROM c JOIN m ON c.sweep_id = m.sweep_id AND c.label = m.label)
SELECT printf('%d-C%02d', sweep_id, label) AS cell_id, ray * 10.0::DOUBLE AS az_deg, CAST(gate AS DOUBLE) AS range_km, dbz_max, CAST(n_gates AS INTEGER) AS n_gates, round(shear, 6) AS shear,
  CAST(row_number() OVER (PARTITION BY sweep_id ORDER BY dbz_max DESC, label) - 1 AS INTEGER) AS cand_idx FROM z WHERE shear >= 0.25::DOUBLE""")
def identify_cells(spark, sf_dir):
    rays, own = _sweeps(spark, sf_dir)
    return cells.identify_cells(rays, own, SMALL).select("cell_id", "az_deg", "range_km", "dbz_max", "n_gates", six(F.col("shear")).alias("shear"), "cand_idx")


@query(f"""WITH {SWEEP_GATES}, c AS (SELECT DISTINCT sweep_id, sweep_id % 36 AS ray, 5 + sweep_id % 30 AS gate, greatest(least(sweep_id % 30 + 5 - 8, 24), 0) AS start FROM sweep_gates),
w AS (SELECT c.sweep_id, y.y, x.x, v.vel FROM c CROSS JOIN (SELECT unnest(range(0, 7)) AS y) y CROSS JOIN (SELECT unnest(range(0, 16)) AS x) x LEFT JOIN sweep_gates v ON v.sweep_id = c.sweep_id AND v.ray_idx = (c.ray + y.y - 3 + 36) % 36 AND v.gate_idx = c.start + x.x),
i AS (SELECT i, i * 0.4::DOUBLE AS y, CAST(least(floor(i * 0.4::DOUBLE), 5) AS INTEGER) AS y0, CAST(least(floor(i * 0.4::DOUBLE + 0.5::DOUBLE), 6) AS INTEGER) AS near FROM (SELECT unnest(range(0, 16)) AS i)),
r AS (SELECT a.sweep_id, i.i, a.x, CASE WHEN n.vel IS NULL THEN 0.0::FLOAT ELSE CAST(coalesce(a.vel, 0.0::DOUBLE) * (1 - (i.y - i.y0)) + coalesce(b.vel, 0.0::DOUBLE) * (i.y - i.y0) AS FLOAT) END AS v
  FROM i JOIN w a ON a.y = i.y0 JOIN w b ON b.sweep_id = a.sweep_id AND b.x = a.x AND b.y = i.y0 + 1 JOIN w n ON n.sweep_id = a.sweep_id AND n.x = a.x AND n.y = i.near),
s AS (SELECT sweep_id, i // 8 AS br, x // 8 AS bc, coalesce(abs(lead(v) OVER (PARTITION BY sweep_id, x ORDER BY i) - v), 0.0::FLOAT) AS step FROM r),
b AS (SELECT sweep_id, br, bc, max(step) AS m FROM s GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY sweep_id ORDER BY m DESC, br, bc) AS rn FROM b),
o AS (SELECT c.*, t.br, t.bc, CAST(t.m / 10.0::FLOAT - 2.0::FLOAT AS DOUBLE) AS logit, (t.br + 0.5::DOUBLE) / 2.0::DOUBLE AS rf, (t.bc + 0.5::DOUBLE) / 2.0::DOUBLE AS cf, greatest(start * 1000.0::DOUBLE - 1000.0::DOUBLE, 0.0::DOUBLE) AS low, (start + 15) * 1000.0::DOUBLE + 1000.0::DOUBLE AS high FROM c JOIN t ON c.sweep_id = t.sweep_id AND rn = 1)
SELECT CAST(sweep_id AS VARCHAR) AS cell_id, round(logit, 5) AS logit, round(1 / (1 + exp(-logit)), 5) AS probability, CAST(br AS INTEGER) AS heatmap_row, CAST(bc AS INTEGER) AS heatmap_col, least(rf, 1 - rf, cf, 1 - cf) AS edge_margin,
  ((ray * 10.0::DOUBLE - 30.0::DOUBLE + rf * 60.0::DOUBLE) % 360.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE AS activation_az_deg, (low + cf * (high - low)) / 1000.0::DOUBLE AS activation_range_km FROM o""")
def chip_scores(spark, sf_dir):
    rays, own = _sweeps(spark, sf_dir)
    k = F.col("scan_key").cast("long")
    placed = own.select("scan_key", F.col("scan_key").alias("cell_id"), (k % 36 * 10.0).alias("az_deg"), (k % 30 + 5).cast("double").alias("range_km"))
    scored = scoring.score(chips.chip_parts(placed, rays, own, SMALL), scoring.ContrastScorer, SMALL)
    return scored.select("cell_id", F.round("logit", 5).alias("logit"), F.round("probability", 5).alias("probability"), "heatmap_row", "heatmap_col", "edge_margin", "activation_az_deg", "activation_range_km")


def _volumes_of_two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """RAYS and VOLUMES of two sweeps a scan. Spectrum width is never there, KDP in the upper sweep only; every third scan
    has no upper sweep, every fifth none near its cell, and every seventh volume has no gate ranges."""
    rays, own = _sweeps(spark, sf_dir)
    k, blank = F.col("scan_key").cast("long"), F.lit(None).cast("array<float>")
    scaled = lambda c, by: F.transform(c, lambda v: (v / by).cast("float"))
    fields = {"reflectivity": F.col("reflectivity"), "velocity": F.col("velocity"), "cross_correlation_ratio": scaled("reflectivity", 64), "differential_reflectivity": scaled("velocity", 8)}
    keys = ["site", "scan_key", "ray_idx", "azimuth_deg"]
    low = rays.select(*keys, F.lit(0).alias("sweep_idx"), F.lit(0.3).alias("elevation_deg"), *[fields.get(f, blank).alias(f) for f in FIELDS])
    fields |= {"reflectivity": scaled("reflectivity", 2), "specific_differential_phase": scaled("reflectivity", 16)}
    apart = F.pmod(F.col("ray_idx") - k % 36 + 18, F.lit(36)) - 18
    high = rays.where((k % 3 != 0) & ((k % 5 != 0) | (F.abs(apart) > 3))).select(*keys, F.lit(1).alias("sweep_idx"), F.lit(1.2).alias("elevation_deg"), *[fields.get(f, blank).alias(f) for f in FIELDS])
    return low.unionByName(high), own.withColumn("range_m", F.when(k % 7 != 0, F.col("range_m")).otherwise(F.array().cast("array<double>")))


@query(f"""WITH {SWEEP_GATES}, c AS (SELECT DISTINCT sweep_id, sweep_id % 36 AS ray, greatest(least(sweep_id % 30 + 5 - 8, 24), 0) AS start FROM sweep_gates WHERE sweep_id % 7 <> 0),
s AS (SELECT sweep_id, count(vel) AS vels, count(dbz) AS dbzs FROM sweep_gates GROUP BY sweep_id),
w AS (SELECT c.sweep_id, CAST(count(v.dbz) AS DOUBLE) AS n, coalesce(sum(v.dbz), 0.0::DOUBLE) AS dbz, coalesce(sum(v.vel), 0.0::DOUBLE) AS vel, count(v.vel) AS seen
  FROM c CROSS JOIN (SELECT unnest(range(-3, 4)) AS y) y CROSS JOIN (SELECT unnest(range(0, 16)) AS x) x LEFT JOIN sweep_gates v ON v.sweep_id = c.sweep_id AND v.ray_idx = (c.ray + y.y + 36) % 36 AND v.gate_idx = c.start + x.x GROUP BY c.sweep_id),
t AS (SELECT w.*, tilt, CASE WHEN tilt = 1 AND (w.sweep_id % 3 = 0 OR w.sweep_id % 5 = 0) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS there FROM w, (SELECT unnest([0, 1]) AS tilt)),
k AS (SELECT unnest(['DBZ', 'VEL', 'KDP', 'RHOHV', 'ZDR', 'WIDTH', 'range_folded_mask']) AS channel)
SELECT CAST(sweep_id AS VARCHAR) AS cell_id, CAST(tilt AS INTEGER) AS tilt, channel, there * CASE channel WHEN 'DBZ' THEN dbz / (1 + tilt) WHEN 'VEL' THEN vel WHEN 'KDP' THEN CASE WHEN tilt = 1 THEN dbz / 16 ELSE 0 END
  WHEN 'RHOHV' THEN dbz / 64 WHEN 'ZDR' THEN vel / 8 WHEN 'WIDTH' THEN 0 ELSE 112 - seen END AS total FROM t, k""")
def chip_channels(spark, sf_dir):
    """Sums of every channel and tilt of chips as they are assembled: what is missing is zero, folded gates are marked,
    and a cell of a volume without gates has no chip."""
    import pandas as pd

    config = dataclasses.replace(SMALL, chip_azimuth_bins=7, target_elevations=(0.5, 0.9))
    rays, own = _volumes_of_two(spark, sf_dir)
    k = F.col("scan_key").cast("long")
    placed = own.select("scan_key", F.col("scan_key").alias("cell_id"), (k % 36 * 10.0).alias("az_deg"), (k % 30 + 5).cast("double").alias("range_km"))

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                chip = chips.assembled(r.parts, r.range_lower_m, r.range_upper_m, config)
                rows += [(r.cell_id, tilt, c, float(chip[c][:, :, tilt].astype("float64").sum())) for c in chips.MODEL_KEYS[:-1] for tilt in (0, 1)]
            yield pd.DataFrame(rows, columns=["cell_id", "tilt", "channel", "total"])

    parts = chips.chip_parts(placed, rays, own, config).select("cell_id", "parts", "range_lower_m", "range_upper_m")
    return parts.mapInPandas(run, "cell_id string, tilt int, channel string, total double")


@query(f"""WITH {SWEEP_GATES}, c AS (SELECT DISTINCT sweep_id, 5 + sweep_id % 30 AS gate FROM sweep_gates), w AS (SELECT c.sweep_id, greatest(least(gate - 8, 24), 0) AS start FROM c),
x AS (SELECT sweep_id, i, greatest((greatest(start * 1000.0::DOUBLE - 1000.0::DOUBLE, 0.0::DOUBLE) + 250.0::DOUBLE) * 1e-5::DOUBLE + i * (((start + 15) * 1000.0::DOUBLE + 1000.0::DOUBLE - 250.0::DOUBLE) * 1e-5::DOUBLE - (greatest(start * 1000.0::DOUBLE - 1000.0::DOUBLE, 0.0::DOUBLE) + 250.0::DOUBLE) * 1e-5::DOUBLE) / 15.0::DOUBLE, 2125.0::DOUBLE * 1e-5::DOUBLE) AS r FROM w, (SELECT unnest(range(0, 16)) AS i))
SELECT CAST(sweep_id AS VARCHAR) AS cell_id, CAST(i AS INTEGER) AS gate, round(r, 5) AS scaled_range, round(1 / r, 3) AS inverse_range FROM x""")
def chip_coordinates(spark, sf_dir):
    """The coordinate channels of chips: built from the window's bounds, in task as chips are."""
    import pandas as pd

    keys = _sweeps(spark, sf_dir)[1]
    k = F.col("scan_key").cast("long")
    window = chips.range_window(F.col("range_m"), (k % 30 + 5).cast("double"), SMALL.chip_range_m, SMALL.chip_range_gates)
    bounds = keys.select("scan_key", window.alias("w")).select("scan_key", "w.lower_m", "w.upper_m")

    def run(batches):
        for batch in batches:
            rows = [(r.scan_key, i, float(a), float(b)) for r in batch.itertuples() for i, (a, b) in enumerate(chips.coordinates(r.lower_m, r.upper_m, 1, 16)[0].astype("float64"))]
            yield pd.DataFrame(rows, columns=["cell_id", "gate", "a", "b"])

    return bounds.mapInPandas(run, "cell_id string, gate int, a double, b double").select("cell_id", "gate", F.round("a", 5).alias("scaled_range"), F.round("b", 3).alias("inverse_range"))


# --- derived fields and many maps -------------------------------------------------------------------------------------


@query(f"""WITH {SWEEP_GATES},
w AS (SELECT a.sweep_id, a.ray_idx, g.gate_idx, regr_slope(a.dbz, CAST(a.gate_idx AS DOUBLE)) AS slope, count(*) AS n
  FROM sweep_gates a JOIN (SELECT unnest(range(0, 40)) AS gate_idx) g ON a.gate_idx BETWEEN g.gate_idx - 6 AND g.gate_idx + 6 GROUP BY 1, 2, 3)
SELECT sweep_id, ray_idx, CAST(gate_idx AS INTEGER) AS gate_idx, round(slope / 2.0::DOUBLE / 0.25::DOUBLE + 1e-9::DOUBLE, 6) AS kdp FROM w WHERE n >= 4""")
def derived_phase(spark, sf_dir):
    """Slopes of phase along rays: windows of 13 gates, of which 4 must have a value."""
    rays = _rays(sweep_gates(spark, sf_dir))
    slopes = phase.specific_phase(F.col("dbz"), F.lit(0.25), 6, 4)
    rows = rays.select(F.col("scan_key").alias("sweep_id"), "ray_idx", F.posexplode(slopes).alias("gate_idx", "kdp"))
    return rows.where(F.col("kdp").isNotNull()).withColumn("kdp", F.round(F.col("kdp") + 1e-9, 6))  # many values are ties of six digits


@query("""WITH p AS (SELECT c_name AS name, CAST(c_custkey * 7919 % 3600 AS DOUBLE) / 10.0::DOUBLE - 180.0::DOUBLE AS lon, CAST(c_custkey * 104729 % 1700 AS DOUBLE) / 10.0::DOUBLE - 85.0::DOUBLE AS lat, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(floor(c_acctbal * 100) AS BIGINT) END AS pop_max FROM customer),
b AS (SELECT s_suppkey AS map, CAST(s_suppkey * 37 % 340 - 175 AS DOUBLE) AS west, CAST(s_suppkey * 53 % 150 - 80 AS DOUBLE) AS south, CAST(s_suppkey % 7 * 4 + 1 AS DOUBLE) AS side FROM supplier),
r AS (SELECT map, name, lon, lat, pop_max, row_number() OVER (PARTITION BY map ORDER BY coalesce(pop_max, 0) DESC, name) AS place_rank
  FROM b JOIN p ON lon BETWEEN west AND west + side AND lat BETWEEN south AND south + side * 0.7::DOUBLE WHERE coalesce(pop_max, 0) >= 1000)
SELECT map, CAST(place_rank AS INTEGER) AS place_rank, name, lon, lat, pop_max FROM r WHERE place_rank <= 20""")
def places_on_maps(spark, sf_dir):
    """The most populous customers on a map around every supplier."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    places = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), ((k * 7919 % 3600).cast("double") / 10.0 - 180.0).alias("lon"), ((k * 104729 % 1700).cast("double") / 10.0 - 85.0).alias("lat"), F.when(k % 9 != 0, F.floor(F.col("c_acctbal") * 100)).alias("pop_max"))
    side = (s % 7 * 4 + 1).cast("double")
    maps = read(spark, sf_dir, "supplier").select(s.alias("map"), (s * 37 % 340 - 175).cast("double").alias("west"), (s * 53 % 150 - 80).cast("double").alias("south"), side.alias("side"))
    maps = maps.select("map", "west", (F.col("west") + F.col("side")).alias("east"), "south", (F.col("south") + F.col("side") * 0.7).alias("north"))
    return reports.places_on_maps(places, maps, 1000, 20)
