"""Queries over whole life cycles: rounds of polling over an archive, the queue's seeding, orders and pads of tables."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewatch.config import EngineConfig
from galewatch.functions.tables import shared_dir
from galewatch.operators.scoring import ContrastScorer
from galewatch.plans import archive_queries, polling, reports
from galewatch.plans.radar_queries import CONFIG, HIST, _activity_sql, _track_table, query
from galewatch.plans.views import CAND, attempts, candidates, read
from galewatch.streaming import schedule, tracker

#: The newest scan of every site is of this time, the one before it five minutes older.
LAST = datetime(2024, 5, 1, 12, 0)
ROUNDS = EngineConfig(cell_min_gates=4, chip_azimuth_bins=16, chip_range_gates=16, confidence_threshold=0.01, detection_min_gates=1)
SITES = ("KAAA", "KBBB", "KCCC", "KDDD", "KEEE")
VOLUME_COUNTS = """v AS (SELECT l_suppkey % 4 AS s, l_linenumber % 2 AS j, count(*) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT CASE s WHEN 0 THEN 'KAAA' WHEN 1 THEN 'KBBB' WHEN 2 THEN 'KCCC' ELSE 'KDDD' END AS site, j, CASE WHEN n % 5 = 0 THEN 'error' WHEN n % 3 = 0 THEN 'no_cells' ELSE 'processed' END AS status, n % 30 AS ray FROM v)"""


def sited_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two volumes for each of four sites, of what a quarter and a half of the line items number: broken ones, some
    without a storm, and some with one."""
    li = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("s"), (F.col("l_linenumber") % 2).alias("j")).agg(F.count("*").alias("n"))
    site = F.element_at(F.array(*map(F.lit, SITES)), (F.col("s") + 1).cast("int"))
    at = F.timestamp_seconds(F.lit(int((LAST - datetime(1970, 1, 1)).total_seconds())) - (1 - F.col("j")) * 300)
    told = F.to_json(F.struct("n", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("time")))
    return li.select(site.alias("site"), F.to_date(at).alias("scan_date"), F.concat(site, F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_V06")).alias("filename"), told.cast("binary").alias("content"))


def decoded(path: str, content: bytes) -> pd.DataFrame:
    told = json.loads(content)
    if told["n"] % 5 == 0:
        raise ValueError("broken")
    storm = told["n"] % 3 != 0
    rows = []
    for ray in range(36):
        echo = [50.0 if storm and abs(ray - 2 - told["n"] % 30) <= 1 and 20 <= g < 24 else None for g in range(40)]
        rows.append({"sweep_idx": 0, "ray_idx": ray, "azimuth_deg": ray * 10.0, "elevation_deg": 0.5, "reflectivity": echo, "velocity": [float(20 * (ray % 2)) if v else 0.0 for v in echo]})
    return pd.DataFrame(rows).assign(scan_time=pd.Timestamp(told["time"]), lat=35.0, lon=-97.0, range_m=[[1000.0 * (g + 1) for g in range(40)]] * 36)


@query(f"""WITH {VOLUME_COUNTS},
r AS (SELECT unnest([1, 2, 3]) AS round), s AS (SELECT unnest(['KAAA', 'KBBB', 'KCCC', 'KDDD', 'KEEE']) AS site)
SELECT CAST(r.round AS INTEGER) AS round, s.site, coalesce(k.status, 'no_new_scan') AS status, CASE WHEN k.status = 'processed' THEN 1 ELSE 0 END AS cells_found, CASE WHEN k.status = 'processed' THEN 1 ELSE 0 END AS chips_processed
FROM r CROSS JOIN s LEFT JOIN k ON k.site = s.site AND k.j = 2 - r.round""")
def polling_rounds(spark, sf_dir):
    """Three rounds over an archive of five sites, all due each time: newest scan, the one before, and nothing new. The
    second is cut off before its attempts are written, and ended by the third."""
    root = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
    archive_queries.written(spark, sited_volumes(spark, sf_dir), f"{root}/archive")
    sites = spark.createDataFrame([(s, 35.0, -97.0, 1, s, "UTC") for s in SITES], "site_id string, lat double, lon double, elev_ft int, name string, timezone string")
    times = [LAST + timedelta(minutes=m) for m in (1, 2, 3)]
    tools = (decoded, ContrastScorer, ROUNDS)
    polling.poll(spark, f"{root}/archive", f"{root}/state", sites, *tools, now=times[0], overwrite=True)
    polling.begin(spark, f"{root}/archive", f"{root}/state", sites, times[1], ROUNDS, overwrite=True)  # cut off after its note
    polling.poll(spark, f"{root}/archive", f"{root}/state", sites, *tools, now=times[2], overwrite=True)
    noted = spark.read.schema(polling.NOTED).option("recursiveFileLookup", "true").parquet(f"{root}/state/attempts")
    turn = F.coalesce(*[F.when(F.col("finished_at") == F.lit(t), i + 1) for i, t in enumerate(times)])
    return noted.select(turn.alias("round"), "site", "status", "cells_found", "chips_processed")


@query(f"""WITH a AS ({_activity_sql()}), latest AS (SELECT site, arg_max(delay_seconds, seq) AS delay_seconds, arg_max(priority, seq) AS priority FROM a GROUP BY site),
s AS (SELECT DISTINCT event_type AS site FROM events UNION ALL SELECT DISTINCT 'new-' || event_type FROM events), o AS (SELECT unnest([false, true]) AS overwrite)
SELECT o.overwrite, s.site, CAST(CASE WHEN o.overwrite OR l.site IS NULL THEN 0 ELSE l.delay_seconds - 600 END AS BIGINT) AS due_in, CAST(CASE WHEN o.overwrite OR l.site IS NULL THEN 10 ELSE l.priority END AS INTEGER) AS priority
FROM o CROSS JOIN s LEFT JOIN latest l ON l.site = s.site""")
def seeded_queue(spark, sf_dir):
    """The queue with sites that were never tried added, or all of them anew, ten minutes after the last attempts."""
    e = read(spark, sf_dir, "events").select("event_type").distinct()
    names = e.select(F.col("event_type").alias("site")).unionAll(e.select(F.concat(F.lit("new-"), "event_type")))
    states = schedule.site_states(schedule.schedule(attempts(spark, sf_dir), CONFIG)).withColumn("finished_at", F.lit(LAST))
    now = F.lit(LAST + timedelta(seconds=600))
    queues = [schedule.due_queue(states.where(F.lit(not anew)), names, now).withColumn("overwrite", F.lit(anew)) for anew in (False, True)]
    return queues[0].unionByName(queues[1]).select("overwrite", "site", (F.unix_seconds("due_at") - F.unix_seconds(now)).alias("due_in"), "priority")


@query(f"""WITH {HIST}, c AS (SELECT track_id, confirmed, max_prob FROM s)
SELECT track_id, CAST(row_number() OVER (ORDER BY NOT confirmed, max_prob DESC, track_id) AS INTEGER) AS place FROM c""")
def tracks_in_order(spark, sf_dir):
    """The track table's order: confirmed first, then by greatest probability."""
    rows = _track_table(spark, sf_dir)
    return reports.numbered(rows, reports.track_order(), "place").select("track_id", "place")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
p AS (SELECT DISTINCT user_id, unnest(range(0, 8)) AS i FROM events)
SELECT p.user_id, CAST(p.i AS INTEGER) AS i, r.event_id FROM p LEFT JOIN r ON r.user_id = p.user_id AND r.i = p.i""")
def padded_results(spark, sf_dir):
    """Each user's results as a list of eight, cut or filled with nulls."""
    own = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("all"))
    return own.select("user_id", F.posexplode(reports.padded(F.col("all"), 8, "long")).alias("i", "event_id"))


@query(f"""WITH {CAND}, picked AS (SELECT site, arg_min(event_id, -probability * 1e9::DOUBLE + event_id * 1e-9::DOUBLE) AS event_id FROM cand GROUP BY site)
SELECT p.site, CAST(p.event_id AS VARCHAR) AS cell_id, p.event_id % 7 AS chip FROM picked p""")
def selected_chip(spark, sf_dir):
    """The chip of each site's strongest result, first match by cell id; chips repeat."""
    c = candidates(spark, sf_dir).withColumn("cell_id", F.col("event_id").cast("string"))
    chosen = c.groupBy("site").agg(F.max_by("cell_id", F.struct("probability", -F.col("event_id"))).alias("cell_id"))
    chips = c.select("cell_id", (F.col("event_id") % 7).alias("chip"), F.explode(F.sequence(F.lit(0), F.col("event_id") % 3)).alias("turn")).withColumn("chip", F.col("chip") + F.col("turn"))
    return reports.first_match(chosen, chips, "cell_id", ["turn"]).select("site", "cell_id", "chip")


@query("""SELECT event_type AS track_id, max(event_id) AS event_id, CAST(arg_max(value, event_id) AS DOUBLE) AS value FROM events GROUP BY event_type""")
def latest_tracks(spark, sf_dir):
    """Each track as of its last update (an overwrite by id)."""
    e = read(spark, sf_dir, "events")
    o = F.array(F.struct(F.col("event_id").alias("event_id"), F.col("value").alias("value")))
    updates = e.select(F.lit("all").alias("site"), F.col("event_type").alias("track_id"), F.timestamp_seconds("event_id").alias("scan_time"), F.col("event_id").alias("cand_idx"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("confirmed_at"), o.alias("observations"))
    return tracker.tracks_of(updates).select("track_id", F.col("observations")[0]["event_id"].alias("event_id"), F.col("observations")[0]["value"].alias("value"))
