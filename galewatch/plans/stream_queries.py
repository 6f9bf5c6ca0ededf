"""Queries that run a stream to its end over stored events and return what it wrote.

Each one reads the table as a file stream with availableNow, so a run covers the whole table and ends.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewatch.functions.tables import shared_dir
from galewatch.functions.text import iso_utc
from galewatch.plans.radar_queries import CONFIG, _activity_sql, query
from galewatch.plans.tracker_sql import OPEN_SQL, STREAM_SQL
from galewatch.plans.views import EPOCH, attempts, candidates, read, scans
from galewatch.streaming import dedup, schedule, snapshot, tracker
from galewatch.streaming.stores import rocksdb


def finished(spark: SparkSession, rows: DataFrame, make) -> DataFrame:
    """Writes rows where a stream can read them, runs make(stream) with availableNow, returns its output."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/in")
    out = make(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
    out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def fed(spark: SparkSession, parts: list[DataFrame], make) -> str:
    """The same for parts that arrive one after the other: the stream ends and goes on with each. Gives its folder."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for rows in parts:
        rows.write.mode("append").parquet(f"{root}/in")
        out = make(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
        out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return root


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) || event_type AS key FROM events")
def stream_dedup(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.col("user_id").cast("string"), "event_type").alias("key"))
    return finished(spark, rows, lambda s: dedup.first_seen(s, "ts", config=CONFIG).select("key"))


@query(STREAM_SQL)
def stream_tracker(spark, sf_dir):
    updates = finished(spark, scans(candidates(spark, sf_dir)), lambda s: tracker.stream(s, CONFIG, history=False))
    return updates.select("site", iso_utc(F.col("scan_time")).alias("scan_time"), "cand_idx", "cell_id", "track_id", "status", "hits_in_window", "window_size", "newly_confirmed")


@query(_activity_sql())
def stream_schedule(spark, sf_dir):
    return finished(spark, attempts(spark, sf_dir), lambda s: schedule.stream(s, CONFIG))


def halves(rows: DataFrame, by: str) -> list[DataFrame]:
    """The rows up to the middle of their range of `by`, and the others."""
    middle = rows.agg(F.expr(f"(min({by}) + max({by})) div 2")).first()[0]
    return [rows.where(F.coalesce(F.col(by) <= middle, F.lit(True))), rows.where(F.col(by) > middle)]


#: Seconds for which a key is kept after each sighting, in the query below.
KEPT = 86_400


@query(f"""WITH k AS (SELECT event_type || (user_id % 20) AS key, ts FROM events),
g AS (SELECT *, lag(ts) OVER (PARTITION BY key ORDER BY ts) AS before FROM (SELECT DISTINCT key, ts FROM k))
SELECT key, CAST(epoch_us(ts) AS BIGINT) AS at FROM g WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > {KEPT} * 1000000::BIGINT""")
def stream_sliding_dedup(spark, sf_dir):
    """Keys that come and go: new ones, and those unseen for the retention time, counted from their last sighting."""
    e = read(spark, sf_dir, "events").select(F.concat("event_type", (F.col("user_id") % 20).cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("time"))
    parts = [p.drop("us") for p in halves(e.withColumn("us", F.unix_micros("time")), "us")]
    with rocksdb(spark):
        root = fed(spark, parts, lambda s: dedup.sliding_first_seen(s, config=dataclasses.replace(CONFIG, processed_ttl_seconds=KEPT)))
    return spark.read.parquet(f"{root}/out").select("key", F.unix_micros("time").alias("at"))


#: Seconds between the attempts of all sites, in the query below.
APART = 60


@query(f"""WITH a AS ({_activity_sql()}),
t AS (SELECT *, seq * {APART} + {EPOCH} AS ended FROM a),
n AS (SELECT *, ended + delay_seconds AS due, lead(ended) OVER (PARTITION BY site ORDER BY seq) AS following, max(ended) OVER () AS latest FROM t)
SELECT site, CAST(due AS BIGINT) AS due_at, priority FROM n WHERE due <= coalesce(following, latest)""")
def stream_due_sites(spark, sf_dir):
    """When each site became due, told by timers over the attempts' times."""
    rows = schedule.schedule(attempts(spark, sf_dir), CONFIG).withColumn("finished_at", F.timestamp_seconds(F.col("seq") * APART + EPOCH))
    with rocksdb(spark):
        root = fed(spark, halves(rows, "seq"), schedule.due_sites)
    return spark.read.parquet(f"{root}/out").select("site", F.unix_seconds("due_at").alias("due_at"), "priority")


@query(OPEN_SQL)
def saved_open_tracks(spark, sf_dir):
    """Open tracks read out of the state store of the tracker's stream."""
    rows = scans(candidates(spark, sf_dir))
    parts = [p.drop("s") for p in halves(rows.withColumn("s", F.unix_seconds("scan_time")), "s")]
    root = fed(spark, parts, lambda s: tracker.stream(s, CONFIG, history=False))
    tracks = tracker.open_tracks(tracker.saved_state(spark, f"{root}/state"))
    last = F.element_at(F.filter("observations", lambda o: ~o["missed"]), -1)
    return tracks.select(
        "site", "track_id", iso_utc(F.col("created_at")).alias("created_at"), iso_utc(F.col("confirmed_at")).alias("confirmed_at"), F.size("observations").alias("observations"),
        F.size(F.filter("observations", lambda o: o["missed"])).alias("missed"), last["cell_id"].alias("last_cell"), F.bround(last["x_km"], 6).alias("x_km"), F.bround(last["y_km"], 6).alias("y_km"),
    )


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_snapshot(spark, sf_dir):
    """Each user's last event, kept up as a table over a stream of four micro-batches."""
    schema = "user_id long, event_id long, event_type string, value double"
    rows = read(spark, sf_dir, "events").select(*[c.split()[0] for c in schema.split(", ")])
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for first in halves(rows, "event_id"):
        for part in halves(first, "event_id"):
            part.write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in").writeStream.option("checkpointLocation", f"{root}/state")
            stream.foreachBatch(snapshot.maintained(f"{root}/users", ["user_id"], ["event_id"])).trigger(availableNow=True).start().awaitTermination()
    return snapshot.read(spark, f"{root}/users", schema)
