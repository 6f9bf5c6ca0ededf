"""Queries over the radar views, each with the SQL that must give the same rows.

Coordinates and other doubles that pass through trigonometry are compared at six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galewatch.config import EngineConfig
from galewatch.functions import geo, text
from galewatch.operators import cells, chips, heatmap, history, quality
from galewatch.plans import reports
from galewatch.plans.tracker_sql import DETECTIONS_SQL, REPLAY_SQL
from galewatch.plans.views import CAND, SITE_DIM, SITES, SWEEP_GATES, attempts, candidates, read, scans, site_dim, sweep_gates
from galewatch.sources import sites as site_source
from galewatch.sources import volumes
from galewatch.streaming import schedule, tracker

CONFIG = EngineConfig()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def six(c: Column) -> Column:
    return F.round(c, 6)


# --- sources ----------------------------------------------------------------------------------------------------------


@query("""WITH base AS (SELECT upper(substr(n_name, 1, 1)) || CAST(n_nationkey AS VARCHAR) AS site_id, CAST(10 + n_nationkey AS DOUBLE) AS lat, CAST(2 * n_nationkey - 100 AS DOUBLE) AS lon,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 100 * n_nationkey + CASE WHEN n_nationkey % 2 = 1 THEN 2 ELSE 0 END END AS elev_ft FROM nation),
b AS (SELECT site_id, lat, lon, elev_ft, site_id AS name, 'UTC' AS timezone FROM base WHERE NOT (site_id LIKE 'T%' AND site_id <> 'TJUA')),
o AS (SELECT upper(substr(n_name, 1, 1)) || CAST(n_nationkey AS VARCHAR) AS site_id, CAST(n_nationkey AS DOUBLE) / 2 AS lat, CAST(NULL AS VARCHAR) AS name FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL SELECT 'REG' || CAST(r_regionkey AS VARCHAR), CAST(r_regionkey AS DOUBLE), r_name FROM region)
SELECT coalesce(o.site_id, b.site_id) AS site_id, coalesce(o.lat, b.lat) AS lat, b.lon, CAST(b.elev_ft AS DOUBLE) AS elev_ft, coalesce(o.name, b.name) AS name, coalesce(b.timezone, 'UTC') AS timezone
FROM b FULL JOIN o ON b.site_id = o.site_id""")
def site_catalog_override(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    key = F.concat(F.upper(F.substring("n_name", 1, 1)), F.col("n_nationkey").cast("string"))
    elev = F.when(F.col("n_nationkey") % 5 == 0, -99999.0).otherwise(F.col("n_nationkey") * 100 + F.when(F.col("n_nationkey") % 2 == 1, 1.5).otherwise(0.5))
    base = n.select(key.alias("site_id"), (F.col("n_nationkey") + 10).alias("lat"), (F.col("n_nationkey") * 2 - 100).alias("lon"), elev.alias("elev"))
    own = n.where(F.col("n_nationkey") % 3 == 0).select(key.alias("site_id"), (F.col("n_nationkey").cast("double") / 2).alias("lat"), F.lit(None).cast("string").alias("name"))
    new = read(spark, sf_dir, "region").select(F.concat(F.lit("REG"), F.col("r_regionkey").cast("string")).alias("site_id"), F.col("r_regionkey").cast("double").alias("lat"), F.col("r_name").alias("name"))
    return site_source.build_catalog(spark, base, own.unionByName(new)).withColumn("elev_ft", F.col("elev_ft").cast("double"))


def _catalog(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HHmmss")
    name = F.concat(F.col("event_type"), F.lit("_"), stamp, F.when(F.col("event_id") % 7 == 0, "_MDM").otherwise(""))
    rows = e.select(F.col("event_type").alias("site"), F.to_date("ts").alias("scan_date"), F.col("event_id").cast("string").alias("key"), F.when(F.col("event_id") % 11 == 0, "").otherwise(name).alias("filename"), "event_id")
    return site_source.with_position(rows, [F.col("event_id")], ["site", "scan_date"]).withColumn("ord", F.col("ord").cast("int")).drop("event_id")


CATALOG = """cat AS (SELECT event_type AS site, CAST(ts AS DATE) AS scan_date, CAST(event_id AS VARCHAR) AS key,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') || CASE WHEN event_id % 7 = 0 THEN '_MDM' ELSE '' END END AS filename,
  CAST(row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) - 1 AS INTEGER) AS ord FROM events),
vols AS (SELECT * FROM cat WHERE NOT ends_with(coalesce(nullif(filename, ''), key), '_MDM'))"""


@query(f"WITH {CATALOG} SELECT site, CAST(scan_date AS VARCHAR) AS scan_date, key, filename, ord FROM vols WHERE scan_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' AND ord BETWEEN 2 AND 20")
def scan_listing_filter(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    listed = catalog.where(F.col("scan_date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-07").cast("date")) & volumes.is_volume(F.col("filename"), F.col("key")))
    return volumes.scan_range(listed, 2, 20).withColumn("scan_date", F.col("scan_date").cast("string"))


@query(f"""WITH {CATALOG}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY scan_date DESC, ord DESC) AS rn FROM vols WHERE CAST(key AS BIGINT) % 5 <> 4)
SELECT site, CAST(scan_date AS VARCHAR) AS scan_date, key, filename, ord FROM r WHERE rn = 1""")
def newest_unprocessed(spark, sf_dir):
    done = read(spark, sf_dir, "events").where(F.col("event_id") % 5 == 4).select(F.col("event_id").cast("string").alias("key"))
    return volumes.newest_unprocessed(_catalog(spark, sf_dir), done).withColumn("scan_date", F.col("scan_date").cast("string"))


@query("SELECT upper(trim(event_type)) AS site, min(event_id) AS event_id FROM events GROUP BY 1")
def dedupe_ordered(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")).alias("site"), "event_id")
    return site_source.distinct_in_order(rows, "site", "event_id")


@query(f"""WITH {SITE_DIM}, e AS (SELECT event_id, upper(event_type) || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS filename, ts FROM events)
SELECT event_id, filename, CASE WHEN length(filename) < 4 THEN NULL ELSE substr(filename, 1, 4) END AS upload_site, upper(event_id::VARCHAR) AS said FROM e""")
def upload_site(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    name = F.concat(F.upper("event_type"), F.lit("_"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HHmmss"))
    return e.select("event_id", name.alias("filename")).select("event_id", "filename", volumes.site_of_upload(F.col("filename")).alias("upload_site"), text.site_key(F.col("event_id").cast("string")).alias("said"))


@query("SELECT event_id, strftime(ts - INTERVAL 6 HOUR, '%b ') || CAST(day(ts - INTERVAL 6 HOUR) AS VARCHAR) || ', ' || CAST(CASE WHEN hour(ts - INTERVAL 6 HOUR) % 12 = 0 THEN 12 ELSE hour(ts - INTERVAL 6 HOUR) % 12 END AS VARCHAR) || strftime(ts - INTERVAL 6 HOUR, ':%M %p') || ' CST' AS label FROM events")
def display_labels(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    name = F.concat(F.lit("KTLX"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HHmmss"), F.lit("_V06"))
    return e.select("event_id", text.display_label(name, F.lit("America/Chicago")).alias("label"))


# --- sweeps and cells -------------------------------------------------------------------------------------------------


@query(f"""WITH {SWEEP_GATES}, s AS (SELECT sweep_id % 10 AS scan, sweep_id, arg_min(CAST((sweep_id * 13 + ray_idx) % 40 AS DOUBLE) / 10.0::DOUBLE, ray_idx) AS elev FROM sweep_gates GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY abs(elev - 0.5::DOUBLE), sweep_id) AS rn FROM s WHERE abs(elev - 0.5::DOUBLE) <= 0.8::DOUBLE)
SELECT scan, sweep_id AS sweep_idx FROM r WHERE rn = 1""")
def nearest_sweep(spark, sf_dir):
    from galewatch.operators.sweeps import nearest_sweep as nearest

    g = sweep_gates(spark, sf_dir)
    elev = F.pmod(F.col("sweep_id") * 13 + F.col("ray_idx"), F.lit(40)).cast("double") / 10.0
    table = g.groupBy((F.col("sweep_id") % 10).alias("scan"), F.col("sweep_id").alias("sweep_idx")).agg(F.min_by(elev, "ray_idx").alias("elevation_deg"))
    return nearest(table, 0.5, 0.8, ["scan"])


@query(f"""WITH {SWEEP_GATES}, s AS (SELECT sweep_id % 10 AS scan, sweep_id, count(*) FILTER (dbz >= 79.0::DOUBLE) AS r, count(*) FILTER (vel > 20.0::DOUBLE) AS v, CAST(sweep_id % 7 AS DOUBLE) / 5.0::DOUBLE AS elev FROM sweep_gates GROUP BY 1, 2),
n AS (SELECT * FROM s WHERE abs(elev - 0.5::DOUBLE) <= 0.5::DOUBLE)
SELECT scan, min(sweep_id) FILTER (r > 0) AS reflectivity, min(sweep_id) FILTER (v > 0) AS velocity FROM n GROUP BY scan HAVING min(sweep_id) FILTER (r > 0) IS NOT NULL OR min(sweep_id) FILTER (v > 0) IS NOT NULL""")
def first_sweep_with_field(spark, sf_dir):
    from galewatch.operators.sweeps import field_sweeps

    g = sweep_gates(spark, sf_dir).groupBy((F.col("sweep_id") % 10).alias("scan"), F.col("sweep_id").alias("sweep_idx")).agg(F.count_if(F.col("dbz") >= 79.0).alias("valid_reflectivity"), F.count_if(F.col("vel") > 20.0).alias("valid_velocity"))
    g = g.withColumn("elevation_deg", (F.col("sweep_idx") % 7).cast("double") / 5.0)
    found = field_sweeps(g, 0.5, 0.5, ["scan"])
    return found.select("scan", F.try_element_at("sweeps", F.lit("reflectivity")).alias("reflectivity"), F.try_element_at("sweeps", F.lit("velocity")).alias("velocity"))


@query(f"WITH {SWEEP_GATES} SELECT sweep_id, ray_idx, gate_idx, dbz FROM sweep_gates WHERE dbz >= 40.0::DOUBLE AND gate_idx >= 10")
def convective_mask(spark, sf_dir):
    g = sweep_gates(spark, sf_dir)
    rays = _rays(g)
    volumes_ = rays.select("scan_key").distinct().withColumn("range_m", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: i * 1000.0))
    return cells.convective_gates(rays, volumes_, CONFIG, "dbz").select(F.col("scan_key").alias("sweep_id"), "ray_idx", F.col("gate_idx"), "dbz")


def _rays(g: DataFrame) -> DataFrame:
    """Gates -> one row a ray with arrays of 40 gates; a gate without an echo is null."""
    own = g.groupBy(F.col("sweep_id").alias("scan_key"), "ray_idx").agg(F.map_from_entries(F.collect_list(F.struct("gate_idx", F.struct("dbz", "vel")))).alias("m"))
    at = F.sequence(F.lit(0), F.lit(39))
    gates = F.transform(at, lambda i: F.try_element_at("m", i))
    return own.select("scan_key", "ray_idx", gates.alias("g")).select("scan_key", "ray_idx", F.col("g.dbz").alias("dbz"), F.col("g.vel").alias("vel"))


@query(f"""WITH RECURSIVE {SWEEP_GATES}, g AS (SELECT sweep_id, ray_idx, gate_idx, dbz, ray_idx * 40 + gate_idx AS p FROM sweep_gates WHERE dbz >= 40.0::DOUBLE),
e AS (SELECT a.sweep_id, a.p AS a, b.p AS b FROM g a JOIN g b ON a.sweep_id = b.sweep_id AND abs(a.ray_idx - b.ray_idx) + abs(a.gate_idx - b.gate_idx) = 1),
reach AS (SELECT sweep_id, p, p AS q FROM g UNION SELECT r.sweep_id, r.p, e.b FROM reach r JOIN e ON r.sweep_id = e.sweep_id AND r.q = e.a),
root AS (SELECT sweep_id, p, min(q) AS r FROM reach GROUP BY 1, 2),
l AS (SELECT sweep_id, p, dense_rank() OVER (PARTITION BY sweep_id ORDER BY r) AS label FROM root),
c AS (SELECT g.sweep_id, l.label, count(*) AS n_gates, max(g.dbz) AS dbz_max, round_even(avg(g.ray_idx), 0) AS y, round_even(avg(g.gate_idx), 0) AS x FROM g JOIN l ON g.sweep_id = l.sweep_id AND g.p = l.p GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT sweep_id, CAST(label AS INTEGER) AS label, CAST(n_gates AS INTEGER) AS n_gates, dbz_max, CAST(y AS INTEGER) AS az_center_idx, CAST(x AS INTEGER) AS range_center_idx,
  CAST(row_number() OVER (PARTITION BY sweep_id ORDER BY dbz_max DESC, label) - 1 AS INTEGER) AS cand_idx FROM c""")
def connected_cells(spark, sf_dir):
    g = sweep_gates(spark, sf_dir).where(F.col("dbz") >= CONFIG.cell_dbz_threshold).select("sweep_id", "ray_idx", "gate_idx", "dbz")
    found = cells.clusters(cells.label_gates(g, "sweep_id"), 5, "sweep_id")
    return cells.rank_cells(found, "sweep_id").select("sweep_id", "label", "n_gates", "dbz_max", "az_center_idx", "range_center_idx", "cand_idx")


@query(f"""WITH {SWEEP_GATES}, s AS (SELECT DISTINCT sweep_id FROM sweep_gates), c AS (SELECT sweep_id, sweep_id % 36 AS ray, 5 + sweep_id % 30 AS gate FROM s),
w AS (SELECT c.sweep_id, c.gate, k.k, (c.ray + k.k + 36) % 36 AS ray_idx FROM c, (SELECT unnest(range(-10, 11)) AS k) k),
a AS (SELECT w.sweep_id, w.gate, w.k, x.gate_idx, g.vel FROM w CROSS JOIN (SELECT unnest(range(0, 40)) AS gate_idx) x LEFT JOIN sweep_gates g ON g.sweep_id = w.sweep_id AND g.ray_idx = w.ray_idx AND g.gate_idx = x.gate_idx WHERE x.gate_idx BETWEEN w.gate - 10 AND w.gate + 10),
d AS (SELECT sweep_id, gate, abs(vel - lag(vel) OVER (PARTITION BY sweep_id, gate_idx ORDER BY k)) AS d FROM a)
SELECT sweep_id, round(coalesce(max(d), 0.0::DOUBLE) / greatest(0.01::DOUBLE, CAST(gate AS DOUBLE) * radians(10.0::DOUBLE)), 6) AS shear FROM d GROUP BY sweep_id, gate""")
def azimuthal_shear(spark, sf_dir):
    rays = _rays(sweep_gates(spark, sf_dir))
    every = rays.select("scan_key").distinct().withColumn("ray_idx", F.explode(F.sequence(F.lit(0), F.lit(35))))
    rays = every.join(rays, ["scan_key", "ray_idx"], "left").select("scan_key", F.lit(0).alias("sweep_idx"), "ray_idx", (F.col("ray_idx") * 10.0).alias("azimuth_deg"), F.coalesce("vel", F.array_repeat(F.lit(None).cast("double"), 40)).alias("velocity"))
    keys = rays.select("scan_key").distinct()
    own = keys.select("scan_key", F.col("scan_key").cast("string").alias("cell_id"), (F.col("scan_key") % 36 * 10.0).alias("az_deg"), (F.col("scan_key") % 30 + 5).cast("double").alias("range_km"))
    vols = keys.withColumn("range_m", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: i * 1000.0))
    sweeps = keys.withColumn("sweeps", F.create_map(F.lit("velocity"), F.lit(0)))
    return cells.azimuthal_shear(own, rays, vols, sweeps, CONFIG).select(F.col("scan_key").alias("sweep_id"), six(F.col("shear")).alias("shear"))


@query(f"""WITH {CAND}, r AS (SELECT i, CAST((i * 17) % 360 AS DOUBLE) AS a FROM (SELECT unnest(range(0, 72)) AS i)),
u AS (SELECT event_id, i, az_deg, az_deg + (((a - az_deg + 180.0::DOUBLE) % 360.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE) - 180.0::DOUBLE AS u FROM cand, r)
SELECT event_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY u, i) AS rays FROM u WHERE u BETWEEN az_deg - 30.0::DOUBLE AND az_deg + 30.0::DOUBLE GROUP BY event_id""")
def azimuth_window(spark, sf_dir):
    azimuths = F.array(*[F.lit(float(i * 17 % 360)) for i in range(72)])
    rows = candidates(spark, sf_dir)
    return rows.select("event_id", F.array_join(chips.azimuth_window(azimuths, F.col("az_deg"), CONFIG.chip_azimuth_span_deg).cast("array<string>"), ",").alias("rays"))


@query(f"""WITH {CAND}, n AS (SELECT event_id, range_km, CAST(round_even(range_km - 2.0::DOUBLE, 0) AS INTEGER) AS c FROM cand),
m AS (SELECT event_id, greatest(0, least(199, c)) AS c FROM n), s AS (SELECT event_id, greatest(least(c - 30, 140), 0) AS start FROM m)
SELECT event_id, CAST(start AS INTEGER) AS start, 60 AS n, greatest(0.0::DOUBLE, CAST(start + 2 AS DOUBLE) * 1000.0::DOUBLE - 1000.0::DOUBLE) AS lower_m, CAST(start + 61 AS DOUBLE) * 1000.0::DOUBLE + 1000.0::DOUBLE AS upper_m FROM s""")
def range_window(spark, sf_dir):
    ranges = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: (i + 2) * 1000.0)
    w = chips.range_window(ranges, F.col("range_km"), CONFIG.chip_range_m, CONFIG.chip_range_gates)
    return candidates(spark, sf_dir).select("event_id", w.alias("w")).select("event_id", "w.*")


# --- geometry and scores ----------------------------------------------------------------------------------------------


@query(f"""WITH {CAND}, p AS (SELECT event_id, range_km * sin(radians(az_deg)) AS x, range_km * cos(radians(az_deg)) AS y, activation_range_km * sin(radians(activation_az_deg)) AS ax, activation_range_km * cos(radians(activation_az_deg)) AS ay FROM cand)
SELECT event_id, round(x, 6) AS x_km, round(y, 6) AS y_km, round(sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)), 6) AS apart_km FROM p""")
def polar_to_xy(spark, sf_dir):
    c = candidates(spark, sf_dir)
    x, y = geo.polar_xy(F.col("az_deg"), F.col("range_km"))
    ax, ay = geo.polar_xy(F.col("activation_az_deg"), F.col("activation_range_km"))
    return c.select("event_id", six(x).alias("x_km"), six(y).alias("y_km"), six(geo.distance_km(x, y, ax, ay)).alias("apart_km"))


def placed_sql(source: str) -> str:
    """CTEs up to `placed`: the source's columns (lat0, lon0, az and km among them) with lat and lon of the place there."""
    a, f = geo.AXIS_M, geo.FLATTENING
    b = a * (1 - f)
    d = lambda v: f"{v!r}::DOUBLE"
    step = lambda i: f"v{i + 1} AS (SELECT *, z + bb * sin(g{i}) * (cos(2 * s1 + g{i}) + bb / 4 * (cos(g{i}) * (-1 + 2 * power(cos(2 * s1 + g{i}), 2)) - bb / 6 * cos(2 * s1 + g{i}) * (-3 + 4 * power(sin(g{i}), 2)) * (-3 + 4 * power(cos(2 * s1 + g{i}), 2)))) AS g{i + 1} FROM v{i})"
    return f"""q AS (SELECT *, radians(az) AS al, atan((1 - {d(f)}) * tan(radians(lat0))) AS u, km * 1000.0::DOUBLE AS s FROM {source}),
q1 AS (SELECT *, atan2(tan(u), cos(al)) AS s1, cos(u) * sin(al) AS sa FROM q),
q2 AS (SELECT *, (1 - sa * sa) AS ca, (1 - sa * sa) * {d((a * a - b * b) / (b * b))} AS uu FROM q1),
q3 AS (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS aa, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM q2),
v0 AS (SELECT *, s / ({d(b)} * aa) AS z, s / ({d(b)} * aa) AS g0 FROM q3), {", ".join(step(i) for i in range(3))},
e AS (SELECT *, sin(u) * sin(g3) - cos(u) * cos(g3) * cos(al) AS t, cos(2 * s1 + g3) AS m, {d(f)} / 16 * ca * (4 + {d(f)} * (4 - 3 * ca)) AS c, atan2(sin(g3) * sin(al), cos(u) * cos(g3) - sin(u) * sin(g3) * cos(al)) AS lam FROM v3),
placed AS (SELECT *, degrees(atan2(sin(u) * cos(g3) + cos(u) * sin(g3) * cos(al), (1 - {d(f)}) * sqrt(sa * sa + t * t))) AS lat,
  lon0 + degrees(lam - (1 - c) * {d(f)} * sa * (g3 + c * sin(g3) * (m + c * cos(g3) * (-1 + 2 * m * m)))) AS lon FROM e)"""


#: Events with the place of their site, for placed_sql.
SITED = f"{CAND}, {SITE_DIM}, sited AS (SELECT cand.*, site_dim.lat AS lat0, site_dim.lon AS lon0, az_deg AS az, range_km AS km FROM cand JOIN site_dim ON site = site_id)"


@query(f"WITH {SITED}, {placed_sql('sited')} SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM placed")
def geodesic_forward(spark, sf_dir):
    rows = site_source.with_coordinates(candidates(spark, sf_dir), site_dim(spark))
    lat, lon = geo.destination(F.col("site_lat"), F.col("site_lon"), F.col("az_deg"), F.col("range_km"))
    return rows.select("event_id", six(lat).alias("lat"), six(lon).alias("lon"))


@query("WITH s AS (SELECT event_id, 1 / (1 + exp(-(value / 25.0::DOUBLE - 2.0::DOUBLE))) AS p FROM events) SELECT event_id, round(p, 6) AS probability, p >= 0.6::DOUBLE AS above_threshold FROM s")
def sigmoid_threshold(spark, sf_dir):
    p = quality.sigmoid(F.col("value") / 25.0 - 2.0)
    return read(spark, sf_dir, "events").select("event_id", six(p).alias("probability"), quality.above_threshold(p, CONFIG.confidence_threshold).alias("above_threshold"))


@query("""WITH h AS (SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS p FROM embeddings),
r AS (SELECT vec_id, p, p // 8 AS heatmap_row, p % 8 AS heatmap_col FROM h),
f AS (SELECT *, (heatmap_row + 0.5::DOUBLE) / 8.0::DOUBLE AS rf, (heatmap_col + 0.5::DOUBLE) / 8.0::DOUBLE AS cf, CAST(vec_id % 360 AS DOUBLE) AS az FROM r)
SELECT vec_id, CAST(heatmap_row AS INTEGER) AS heatmap_row, CAST(heatmap_col AS INTEGER) AS heatmap_col, least(rf, 1.0::DOUBLE - rf, cf, 1.0::DOUBLE - cf) AS edge_margin,
  ((az - 30.0::DOUBLE + rf * 60.0::DOUBLE) % 360.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE AS activation_az_deg, (20000.0::DOUBLE + cf * 60000.0::DOUBLE) / 1000.0::DOUBLE AS activation_range_km FROM f""")
def heatmap_argmax(spark, sf_dir):
    h = read(spark, sf_dir, "embeddings")
    at = heatmap.argmax(F.col("embedding"))
    rows = h.select("vec_id", *[c.alias(n) for c, n in zip(heatmap.row_col(at, 8), ("heatmap_row", "heatmap_col"))])
    r, c = F.col("heatmap_row"), F.col("heatmap_col")
    az = (F.col("vec_id") % 360).cast("double")
    a, km = heatmap.activation(r, c, 8, 8, az - 30.0, az + 30.0, F.lit(20000.0), F.lit(80000.0))
    return rows.select("vec_id", "heatmap_row", "heatmap_col", heatmap.edge_margin(r, c, 8, 8).alias("edge_margin"), a.alias("activation_az_deg"), km.alias("activation_range_km"))


QUALITY = f"""{CAND}, q AS (SELECT *, probability >= 0.6::DOUBLE AS above_threshold, CASE WHEN probability >= 0.6::DOUBLE THEN concat_ws('; ',
  CASE WHEN range_km < 40.0::DOUBLE THEN printf('range %.1fkm < 40.0km', range_km) END, CASE WHEN n_gates < 100 THEN printf('n_gates %d < 100', n_gates) END,
  CASE WHEN edge_margin < 0.1::DOUBLE THEN printf('heatmap edge margin %.3f < 0.100', edge_margin) END) ELSE '' END AS reasons FROM cand)"""


@query(f"WITH {QUALITY} SELECT event_id, above_threshold, reasons, above_threshold AND reasons = '' AS actionable, CASE WHEN above_threshold AND reasons = '' THEN 'actionable' WHEN above_threshold THEN 'gated' ELSE 'below' END AS marker_class FROM q")
def quality_gates(spark, sf_dir):
    rows = quality.evaluate(candidates(spark, sf_dir), CONFIG)
    return rows.select("event_id", "above_threshold", text.joined_reasons(F.col("reasons")).alias("reasons"), "actionable", quality.marker_class(F.col("above_threshold"), F.col("actionable")).alias("marker_class"))


@query(f"""WITH {CAND}, {SITE_DIM} SELECT site, scan_no, any_value(lat) AS site_lat, any_value(lon) AS site_lon, count(*) AS n_cells, count(*) FILTER (probability >= 0.6::DOUBLE) AS n_raw,
  count(*) FILTER (probability >= 0.6::DOUBLE AND range_km >= 40.0::DOUBLE AND n_gates >= 100 AND coalesce(edge_margin, 1.0::DOUBLE) >= 0.1::DOUBLE) AS n_actionable, max(probability) AS max_prob, max(dbz_max) AS dbz_max, CAST(sum(n_gates) AS BIGINT) AS gates
FROM cand JOIN site_dim ON site = site_id GROUP BY site, scan_no""")
def scan_summary(spark, sf_dir):
    rows = quality.evaluate(candidates(spark, sf_dir), CONFIG)
    found = rows.groupBy("site", "scan_no").agg(F.count("*").alias("n_cells"), F.count_if("above_threshold").alias("n_raw"), F.count_if("actionable").alias("n_actionable"), F.max("probability").alias("max_prob"), F.max("dbz_max").alias("dbz_max"), F.sum("n_gates").alias("gates"))
    return site_source.with_coordinates(found, site_dim(spark))  # after the aggregation: five rows of a dimension meet few rows


@query(f"""WITH {QUALITY} SELECT count(*) AS cells, count(*) FILTER (above_threshold) AS over_threshold, count(*) FILTER (above_threshold AND reasons <> '') AS gated, coalesce(max(probability), 0.0::DOUBLE) AS max_probability FROM q""")
def run_summary(spark, sf_dir):
    return reports.run_summary(quality.evaluate(candidates(spark, sf_dir), CONFIG))


@query(f"""WITH {CAND}, p AS (SELECT event_id AS id, site, scan_no, scan_no * 300 AS s, range_km * sin(radians(az_deg)) AS x, range_km * cos(radians(az_deg)) AS y, activation_range_km * sin(radians(activation_az_deg)) AS ax, activation_range_km * cos(radians(activation_az_deg)) AS ay FROM cand),
j AS (SELECT a.site, a.scan_no, a.id, b.id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, sqrt((a.ax - b.ax) * (a.ax - b.ax) + (a.ay - b.ay) * (a.ay - b.ay)) AS ad FROM p a JOIN p b ON a.site = b.site AND a.scan_no = b.scan_no + 1)
SELECT site, scan_no, id, other, round(d + 0.35::DOUBLE * coalesce(ad, 0.0::DOUBLE), 6) AS cost FROM j WHERE d <= 15.0::DOUBLE + 120.0::DOUBLE * 300.0::DOUBLE / 3600.0::DOUBLE AND coalesce(ad <= 45.0::DOUBLE, true)""")
def pair_candidates(spark, sf_dir):
    c = candidates(spark, sf_dir)
    (x, y), (ax, ay) = geo.polar_xy(F.col("az_deg"), F.col("range_km")), geo.polar_xy(F.col("activation_az_deg"), F.col("activation_range_km"))
    p = c.select("site", "scan_no", F.col("event_id").alias("id"), x.alias("x"), y.alias("y"), ax.alias("ax"), ay.alias("ay"), F.col("scan_time").alias("at"))
    return history.match_pairs(p, p, CONFIG).withColumn("cost", six(F.col("cost")))


# --- sequences --------------------------------------------------------------------------------------------------------

OBS = "obs AS (SELECT event_id, user_id, ts, value / (value + 50.0::DOUBLE) AS probability, value / (value + 50.0::DOUBLE) >= 0.6::DOUBLE AS above, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 = 0 AS missed, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 <> 0 AS good FROM events)"


def _observations(spark, sf_dir) -> DataFrame:
    """Events of a user as the observations of a track, in the order of their ids."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    p = F.col("value") / (F.col("value") + 50.0)
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), p.alias("probability"), (p >= CONFIG.confidence_threshold).alias("above"), (k % 4 == 0).alias("missed"), (k % 3 != 0).alias("good"))


@query(f"""WITH {OBS} SELECT event_id, CAST(count(*) FILTER (above AND NOT missed) OVER w AS INTEGER) AS hits_in_window, CAST(count(*) OVER w AS INTEGER) AS window_size FROM obs WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""".replace("SELECT event_id, CAST(count", "SELECT event_id, CAST(confirmed_at AS DOUBLE) AS confirmed_at, hits_in_window, window_size FROM (SELECT *, min(CASE WHEN hits_in_window >= 2 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS confirmed_at FROM (SELECT event_id, user_id, CAST(count", 1) + "))")
def n_of_m_confirm(spark, sf_dir):
    rows = history.n_of_m(_observations(spark, sf_dir), "user_id", "event_id", F.col("above") & ~F.col("missed"), CONFIG.track_confirm_scans, CONFIG.track_confirm_window_scans)
    return rows.select("event_id", F.col("confirmed_at").cast("double").alias("confirmed_at"), "hits_in_window", "window_size")


@query(f"""WITH {OBS}, g AS (SELECT *, count(*) FILTER (NOT missed) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM obs)
SELECT event_id, CAST(count(*) FILTER (missed) OVER (PARTITION BY user_id, grp ORDER BY event_id) AS INTEGER) AS misses FROM g""")
def trailing_misses(spark, sf_dir):
    return history.trailing_misses(_observations(spark, sf_dir), "user_id", "event_id", F.col("missed")).select("event_id", "misses")


@query(f"""WITH {OBS} SELECT event_id, last_value(CASE WHEN NOT missed THEN CAST(event_id AS DOUBLE) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seen FROM obs""")
def asof_last_position(spark, sf_dir):
    return history.last_before(_observations(spark, sf_dir), "user_id", "event_id", F.when(~F.col("missed"), F.col("event_id").cast("double")), "last_seen").select("event_id", "last_seen")


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM obs)
SELECT user_id, count(*) FILTER (NOT missed) AS n_observations, coalesce(max(probability) FILTER (NOT missed), 0.0::DOUBLE) AS max_prob, min(event_id) AS oldest FROM r WHERE rn <= 6 GROUP BY user_id""")
def history_trim(spark, sf_dir):
    kept = history.newest(_observations(spark, sf_dir), "user_id", ["event_id"], CONFIG.track_history)
    return kept.groupBy("user_id").agg(F.count_if(~F.col("missed")).alias("n_observations"), F.coalesce(F.max(F.when(~F.col("missed"), F.col("probability"))), F.lit(0.0)).alias("max_prob"), F.min("event_id").alias("oldest"))


def _histories(spark, sf_dir) -> DataFrame:
    """Tracks of the newest observations of each user."""
    kept = history.newest(_observations(spark, sf_dir), "user_id", ["event_id"], CONFIG.track_history)
    x = F.when(~F.col("missed"), F.col("event_id").cast("double"))
    o = F.struct("event_id", F.col("ts").alias("scan_time"), "probability", F.col("above").alias("above_threshold"), x.alias("x_km"), x.alias("y_km"), F.col("good").alias("quality_pass"), "missed")
    tracks = kept.groupBy("user_id").agg(F.array_sort(F.collect_list(o)).alias("observations"))
    hits = F.size(F.filter("observations", lambda o: o["above_threshold"] & ~o["missed"]))
    first = F.get("observations", F.lit(0))["scan_time"]
    return tracks.select(F.col("user_id").cast("string").alias("track_id"), F.lit("all").alias("site"), first.alias("created_at"), F.when(hits >= 2, F.try_element_at("observations", F.lit(-1))["scan_time"]).alias("confirmed_at"), "observations")


HIST = f"""{OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM obs), k AS (SELECT *, above AND good AND NOT missed AS valid FROM r WHERE rn <= 6),
w AS (SELECT *, count(*) FILTER (valid) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS h, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM k),
t AS (SELECT user_id, count(*) FILTER (above AND NOT missed) >= 2 AS confirmed, coalesce(bool_or(h >= 2 AND n = 3), false) AS any_valid, arg_max(valid, event_id) FILTER (NOT missed) AS last_valid, arg_max(ts, event_id) FILTER (NOT missed) AS last_ts,
  count(*) FILTER (NOT missed) AS n_observations, coalesce(max(probability) FILTER (NOT missed), 0.0::DOUBLE) AS max_prob, max(ts) AS newest FROM w GROUP BY user_id),
s AS (SELECT CAST(user_id AS VARCHAR) AS track_id, confirmed, confirmed AND any_valid AS is_valid, coalesce(confirmed AND any_valid AND last_valid AND last_ts = newest, false) AS is_active, n_observations, max_prob FROM t)"""


def _track_table(spark, sf_dir) -> DataFrame:
    tracks = _histories(spark, sf_dir)
    # Each user's newest observation stands for the latest scan.
    tracks = tracks.withColumn("site", F.col("track_id"))
    latest = tracks.select("site", F.array_max(F.transform("observations", lambda o: o["scan_time"])).alias("latest_scan_time"))
    return reports.track_table(tracks, latest, CONFIG)


@query(f"WITH {HIST} SELECT track_id, is_valid, is_active FROM s")
def any_window_valid(spark, sf_dir):
    return _track_table(spark, sf_dir).select("track_id", "is_valid", "is_active")


@query(f"""WITH {HIST} SELECT track_id, CASE WHEN is_active THEN 'valid - active latest scan' WHEN is_valid THEN 'valid - earlier in replay' WHEN confirmed THEN 'persistent model track' ELSE 'pending/stale' END AS status,
  CAST(n_observations AS INTEGER) AS n_observations, max_prob, row_number() OVER (ORDER BY CASE WHEN confirmed THEN 0 ELSE 1 END, max_prob DESC, track_id) AS place FROM s ORDER BY place LIMIT 100""")
def track_status(spark, sf_dir):
    top = _track_table(spark, sf_dir).select("track_id", "status", "n_observations", "max_prob", "confirmed_at").orderBy(*reports.track_order()).limit(100)  # a report of the first hundred
    return top.withColumn("place", F.row_number().over(Window.orderBy(*reports.track_order())).cast("long")).drop("confirmed_at")


@query("""WITH r AS (SELECT n_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS label_rank FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_nationkey, c_custkey, CAST(label_rank AS INTEGER) AS label_rank, CAST([5, 5, -26, -28, 10, -36, 12, -40][(label_rank - 1) % 8 + 1] AS INTEGER) AS dx, CAST([5, -10, 5, -10, 14, 14, -18, -18][(label_rank - 1) % 8 + 1] AS INTEGER) AS dy FROM r WHERE label_rank <= 12""")
def topk_labels(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_acctbal")
    return reports.top_labels(rows, ["n_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")]).select("n_nationkey", "c_custkey", "label_rank", "offset.*")


@query("""SELECT c_name AS name, CAST(c_custkey % 60 - 120 AS DOUBLE) AS lon, CAST(c_custkey % 30 + 25 AS DOUBLE) AS lat, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(floor(c_acctbal * 100) AS BIGINT) END AS pop_max FROM customer
WHERE c_custkey % 60 - 120 BETWEEN -110 AND -80 AND c_custkey % 30 + 25 BETWEEN 30 AND 45 AND coalesce(CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(floor(c_acctbal * 100) AS BIGINT) END, 0) >= 1000 ORDER BY coalesce(pop_max, 0) DESC, name LIMIT 30""")
def places_on_map(spark, sf_dir):
    k = F.col("c_custkey")
    places = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), (k % 60 - 120).cast("double").alias("lon"), (k % 30 + 25).cast("double").alias("lat"), F.when(k % 9 != 0, F.floor(F.col("c_acctbal") * 100)).alias("pop_max"))
    return reports.places_inside(places, -110.0, -80.0, 30.0, 45.0, 1000, 30)


@query(f"""WITH {CAND} SELECT site, round(quantile_cont(range_km, 0.001) - greatest((quantile_cont(range_km, 0.999) - quantile_cont(range_km, 0.001)) * 0.05::DOUBLE, 0.1::DOUBLE), 6) AS west, round(quantile_cont(range_km, 0.999) + greatest((quantile_cont(range_km, 0.999) - quantile_cont(range_km, 0.001)) * 0.05::DOUBLE, 0.1::DOUBLE), 6) AS east,
  round(quantile_cont(az_deg, 0.001) - greatest((quantile_cont(az_deg, 0.999) - quantile_cont(az_deg, 0.001)) * 0.05::DOUBLE, 0.1::DOUBLE), 6) AS south, round(quantile_cont(az_deg, 0.999) + greatest((quantile_cont(az_deg, 0.999) - quantile_cont(az_deg, 0.001)) * 0.05::DOUBLE, 0.1::DOUBLE), 6) AS north FROM cand GROUP BY site""")
def map_extent(spark, sf_dir):
    found = reports.map_extent(candidates(spark, sf_dir).select("site", F.col("range_km").alias("lon"), F.col("az_deg").alias("lat")), ["site"])
    return found.select("site", *[six(F.col(c)).alias(c) for c in ("west", "east", "south", "north")])


# --- state ------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type AS track_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS created, value AS probability, false AS missed FROM events")
def json_state_roundtrip(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp")))
    # An observation without reasons or a missed flag, as older states have them.
    track = F.struct(F.col("event_type").alias("track_id"), F.col("event_type").alias("site"), F.col("at").alias("created_at"), F.array(F.struct(F.col("at").alias("scan_time"), F.col("value").alias("probability"))).alias("observations"))
    back = e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), text.track_from_json(text.track_json(track)).alias("t"))
    o = F.get("t.observations", F.lit(0))
    return back.select("event_id", "k", F.col("t.track_id").alias("track_id"), text.iso_utc(F.col("t.created_at")).alias("created"), o["probability"].alias("probability"), o["missed"].alias("missed"))


def _activity_sql() -> str:
    """The state machine as a recursive query over each site's attempts in turn."""
    return """WITH RECURSIVE a AS (SELECT event_type AS site, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
b AS (SELECT *, ['processed', 'no_new_scan', 'no_cells', 'processed', 'no_new_scan', 'error', 'no_new_scan', 'no_scans', 'processed', 'no_chips'][k % 10 + 1] AS status FROM a),
c AS (SELECT site, seq, n, status, CASE WHEN status = 'processed' AND (k % 5 = 0 OR k % 11 = 0) THEN 'hot' WHEN status = 'processed' AND (k % 3 > 0 OR k % 4 > 0) THEN 'active' WHEN status IN ('no_new_scan', 'error') THEN status ELSE 'quiet' END AS what FROM b),
r AS (SELECT site, CAST(0 AS BIGINT) AS n, CAST(0 AS INTEGER) AS s, CAST(0 AS INTEGER) AS q, CAST(0 AS INTEGER) AS w, CAST(0 AS INTEGER) AS e FROM (SELECT DISTINCT event_type AS site FROM events)
  UNION ALL SELECT c.site, c.n, CASE what WHEN 'hot' THEN 3 WHEN 'active' THEN 2 WHEN 'quiet' THEN 0 WHEN 'error' THEN s ELSE CASE WHEN w >= 2 THEN greatest(0, s - 1) ELSE s END END,
    CASE what WHEN 'hot' THEN 0 WHEN 'active' THEN 0 WHEN 'quiet' THEN q + 1 ELSE q END, CASE what WHEN 'error' THEN w WHEN 'no_new_scan' THEN CASE WHEN w >= 2 THEN 0 ELSE w + 1 END ELSE 0 END, CASE what WHEN 'error' THEN e + 1 ELSE 0 END
  FROM r JOIN c ON c.site = r.site AND c.n = r.n + 1)
SELECT c.site, c.seq, c.status, r.s AS activity_score, r.q AS consecutive_quiet, r.w AS consecutive_no_new, r.e AS consecutive_errors,
  CAST(CASE WHEN c.status = 'error' THEN least(300 * power(2, greatest(r.e - 1, 0)), 1800) WHEN c.status = 'no_scans' THEN 600 WHEN r.s >= 3 THEN 60 WHEN r.s >= 2 THEN 120 WHEN c.status = 'no_new_scan' THEN 300 ELSE least(floor(300 * power(1.5::DOUBLE, greatest(r.q - 1, 0))), 900) END AS INTEGER) AS delay_seconds,
  CASE WHEN c.status = 'error' THEN 30 WHEN c.status = 'no_scans' THEN 25 WHEN r.s >= 3 THEN 0 WHEN r.s >= 2 THEN 5 WHEN c.status = 'no_new_scan' THEN 15 ELSE 20 END AS priority,
  CASE WHEN c.status = 'error' THEN 'error_backoff' WHEN c.status = 'no_scans' THEN 'no_scans_backoff' WHEN r.s >= 3 THEN 'hot_detection_candidate' WHEN r.s >= 2 THEN 'active_cells' WHEN c.status = 'no_new_scan' THEN 'waiting_for_new_scan' ELSE 'quiet_backoff' END AS reason
FROM r JOIN c ON c.site = r.site AND c.n = r.n"""


@query(_activity_sql())
def activity_state(spark, sf_dir):
    return schedule.schedule(attempts(spark, sf_dir), CONFIG)


@query(REPLAY_SQL)
def tracker_replay(spark, sf_dir):
    updates = tracker.replay(scans(candidates(spark, sf_dir)), CONFIG)
    return updates.select("site", text.iso_utc(F.col("scan_time")).alias("scan_time"), "cand_idx", "cell_id", "track_id", "status", "hits_in_window", "window_size", "newly_confirmed", six(F.array_max(F.transform("observations", lambda o: o["probability"]))).alias("max_probability"))


@query(DETECTIONS_SQL)
def detections_export(spark, sf_dir):
    """The tracker's newly confirmed tracks as the detections log, without coordinates (geodesic_forward checks these)."""
    from galewatch.streaming.sinks import detections_table

    c = candidates(spark, sf_dir)
    rows = quality.evaluate(c, CONFIG).withColumns({"cell_id": F.col("event_id").cast("string"), "quality_pass": F.col("actionable"), "shear": F.lit(0.0)})
    return detections_table(rows, tracker.replay(scans(c), CONFIG), site_dim(spark)).drop("lat", "lon")


@query(f"""WITH {SITED}, {placed_sql("sited")} SELECT strftime(scan_time, '%Y-%m-%dT%H:%M:%S+00:00') AS scan_time, site, CAST(event_id AS VARCHAR) AS cell_id, az_deg, range_km, dbz_max, n_gates, round_even(lat, 5) AS lat, round_even(lon, 5) AS lon, floor(probability * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS probability, CASE WHEN probability >= 0.6::DOUBLE THEN 'True' ELSE 'False' END AS above_threshold FROM placed""")
def results_export(spark, sf_dir):
    from galewatch.streaming.sinks import results_table

    rows = quality.evaluate(candidates(spark, sf_dir), CONFIG).withColumn("cell_id", F.col("event_id").cast("string"))
    return results_table(rows, site_dim(spark))


@query(f"WITH {CAND} SELECT event_id, site || '-' || strftime(scan_time, '%Y%m%d%H%M%S') AS scan_key, site || '-' || strftime(scan_time, '%Y%m%d%H%M%S') || printf('-C%02d', event_id) AS cell_id, printf('C%02d', event_id) AS short_label, site || '-' || strftime(scan_time, '%Y%m%d%H%M%S') || printf('-T%04d', event_id) AS track_id, strftime(scan_time, '%Y%m%dT%H%M%SZ') AS image_stamp FROM cand")
def keys_and_labels(spark, sf_dir):
    c = candidates(spark, sf_dir)
    key = text.scan_key(F.col("site"), F.col("scan_time"))
    cell = text.cell_id(key, F.col("event_id"))
    return c.select("event_id", key.alias("scan_key"), cell.alias("cell_id"), text.short_label(cell).alias("short_label"), text.track_id(F.col("site"), F.col("scan_time"), F.col("event_id")).alias("track_id"), text.image_stamp(F.col("scan_time")).alias("image_stamp"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_summary(spark, sf_dir)
