"""The loop over due sites: a round lists, chooses, decodes, scores and tracks what is due, and notes what became of it.

A folder holds all state as Parquet. A round is done once, wherever it is cut off:

* Before anything else it notes its id, the queue and the keys it has chosen, in `pending/<id>`. A later call finds the
  note and ends that round first, under its own id and at its own time, so it replaces what had been written: every
  table has a folder per round. The note goes last.
* Scans reach the tracker by a stream over `inbox`, whose checkpoint takes a file once. If a file had to be written
  again, the tracker leaves out scans that it had (tracker.stream), and what it gave is in the round's own folder.
* The counters of each site are a snapshot (streaming.snapshot); an attempt that is in it already changes nothing.

A round reads the snapshot of sites, the processed keys of the retention time, and what it writes itself, and never a log
of all rounds: `scans`, `updates`, `results`, `detections` and `attempts` are there for readers. Files of the inbox go
once they are taken; keys go after the retention time. One process at a time works on a folder; several deal the sites
among themselves by `share`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewatch.config import EngineConfig
from galewatch.functions.tables import children, path_exists, remove, stored
from galewatch.operators.scoring import Scorer
from galewatch.plans import engine
from galewatch.schemas import ATTEMPTS, SCAN_CATALOG, SCANS, SCHEDULE, UPDATES
from galewatch.sources import volumes
from galewatch.streaming import schedule, sinks, snapshot, tracker

NOTED = ATTEMPTS + ", finished_at timestamp"
SITE_STATES = SCHEDULE + ", finished_at timestamp"
PLAN = "site string, due_at timestamp, priority int, due boolean, scan_date date, key string, filename string, ord int"
ID = "%Y%m%d%H%M%S%f"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def due_now(spark: SparkSession, folder: str, sites: DataFrame, now: datetime, config: EngineConfig, overwrite: bool = False) -> DataFrame:
    """The queue (schedule.due_queue) of sites (site). overwrite: every site is due, as if none had been tried."""
    states = snapshot.read(spark, f"{folder}/sites", SITE_STATES)
    return schedule.due_queue(states.where(F.lit(not overwrite)), sites, F.lit(now))


def processed_keys(spark: SparkSession, folder: str, now: datetime, config: EngineConfig) -> DataFrame:
    """key: what was processed within the retention time. Only that many days are read, and older ones are removed."""
    oldest = f"day={now - timedelta(seconds=config.processed_ttl_seconds):%Y%m%d}"
    days = children(spark, f"{folder}/processed")
    for day in days:
        if day < oldest:
            remove(spark, f"{folder}/processed/{day}")
    held = [f"{folder}/processed/{day}" for day in days if day >= oldest]
    return spark.read.schema("key string").option("recursiveFileLookup", "true").parquet(*held) if held else spark.createDataFrame([], "key string")


def begin(spark: SparkSession, archive: str, folder: str, sites: DataFrame, now: datetime, config: EngineConfig, overwrite: bool = False) -> str:
    """Chooses what a round does and notes it; gives the round's id. Nothing else is written."""
    queue = stored(due_now(spark, folder, sites.select(F.col("site_id").alias("site")), now, config, overwrite), "queue")
    due = [r["site"] for r in queue.where("due").select("site").collect()]  # at most the catalog
    catalog = volumes.read_catalog(spark, archive, due, (now - timedelta(days=1)).date(), now.date())
    chosen = engine.due_scans(catalog, processed_keys(spark, folder, now, config), queue).drop("due_at", "priority")
    mark = f"{now:{ID}}"
    queue.join(chosen, "site", "left").select(*names(PLAN)).write.mode("overwrite").parquet(f"{folder}/pending/{mark}")
    return mark


def unfinished(spark: SparkSession, folder: str) -> list[str]:
    """Ids of rounds that were begun and not ended, oldest first; a note that was cut off itself is of no round."""
    return [m for m in children(spark, f"{folder}/pending") if path_exists(spark, f"{folder}/pending/{m}/_SUCCESS")]


#: RAYS, VOLUMES, make_scorer, config -> scored cells, as engine.scored_cells gives them.
Process = Callable[[DataFrame, DataFrame, Callable[[], Scorer], EngineConfig], DataFrame]


def finish(spark: SparkSession, folder: str, mark: str, sites: DataFrame, decoder: volumes.Decoder, make_scorer: Callable[[], Scorer], config: EngineConfig, process: Process = engine.scored_cells) -> DataFrame:
    """Does what the round's note says, whatever of it was done before; gives its attempts."""
    now = datetime.strptime(mark, ID)
    place = lambda table: f"{folder}/{table}/day={now:%Y%m%d}/round={mark}"
    plan = spark.read.schema(PLAN).parquet(f"{folder}/pending/{mark}")
    queue = plan.select("site", "due_at", "priority", "due")
    chosen = plan.where(F.col("key").isNotNull()).select(*names(SCAN_CATALOG))
    decoded = volumes.decode(volumes.contents(spark, chosen), decoder)
    vols = decoded.volumes
    cells = stored(process(decoded.rays, vols, make_scorer, config), "cells")
    scans = stored(tracker.scans_of(cells, vols.select("site", "scan_key", "scan_time")).select("site", "scan_time", "candidates"), "scans")
    scans.write.mode("overwrite").parquet(place("scans"))
    if not path_exists(spark, f"{folder}/inbox/{mark}/_SUCCESS"):
        scans.write.mode("overwrite").parquet(f"{folder}/inbox/{mark}")
    inbox = spark.readStream.schema(SCANS).option("recursiveFileLookup", "true").parquet(f"{folder}/inbox")
    engine.stream_scans(inbox, place("updates"), f"{folder}/tracker", config).awaitTermination()
    told = spark.read.schema(tracker.OUTPUT).parquet(f"{place('updates')}/batch=*") if path_exists(spark, place("updates")) else spark.createDataFrame([], tracker.OUTPUT)
    updates = stored(told.select(*names(UPDATES), "created_at", "confirmed_at", "observations"), "updates")
    sinks.results_table(cells, sites).write.mode("overwrite").parquet(place("results"))
    sinks.detections_table(cells, updates, sites).write.mode("overwrite").parquet(place("detections"))
    outcomes = engine.scan_outcomes(vols, cells, cells, updates)
    noted = engine.attempts_of(outcomes, queue, decoded.failed).withColumn("seq", F.lit(int(now.timestamp() * 1e6))).withColumn("finished_at", F.lit(now))
    noted.select(*names(NOTED)).write.mode("overwrite").parquet(place("attempts"))
    noted = spark.read.schema(NOTED).parquet(place("attempts"))
    chosen.select("key").write.mode("overwrite").parquet(place("processed"))
    states = snapshot.read(spark, f"{folder}/sites", SITE_STATES)
    states = schedule.site_states(schedule.continued(states, noted, config)).withColumn("finished_at", F.lit(now))
    snapshot.merge(states.select(*names(SITE_STATES)), f"{folder}/sites", ["site"], ["seq"])
    remove(spark, f"{folder}/inbox/{mark}")  # taken, and the tracker's checkpoint says so
    remove(spark, f"{folder}/pending/{mark}/_SUCCESS")  # the round ends with this
    remove(spark, f"{folder}/pending/{mark}")
    return noted


def poll(spark: SparkSession, archive: str, folder: str, sites: DataFrame, decoder: volumes.Decoder, make_scorer: Callable[[], Scorer], config: EngineConfig | None = None, now: datetime | None = None, overwrite: bool = False, process: Process = engine.scored_cells) -> DataFrame:
    """One round over SITES, after those that were cut off; gives its attempts. process: what is done with its scans."""
    config = config or EngineConfig()
    for mark in unfinished(spark, folder):
        finish(spark, folder, mark, sites, decoder, make_scorer, config, process)
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    mark = begin(spark, archive, folder, sites, now, config, overwrite)
    return finish(spark, folder, mark, sites, decoder, make_scorer, config, process)


def run(spark: SparkSession, archive: str, folder: str, sites: DataFrame, decoder: volumes.Decoder, make_scorer: Callable[[], Scorer], config: EngineConfig | None = None, rounds: int | None = None, overwrite: bool = False, process: Process = engine.scored_cells) -> None:
    """Round after round, waiting in between for the hottest poll interval; overwrite holds for the first."""
    config, done = config or EngineConfig(), 0
    while rounds is None or done < rounds:
        if done:
            time.sleep(config.hot_poll_seconds)
        poll(spark, archive, folder, sites, decoder, make_scorer, config, overwrite=overwrite and done == 0, process=process)
        done += 1


def share(spark: SparkSession, folder: str, sites: DataFrame, worker: int, workers: int) -> tuple[str, DataFrame]:
    """The folder and the sites of one of several processes that work side by side.

    A site belongs to one worker by a hash of its id, and a worker keeps its state and tables in a folder of its own, so
    workers share nothing and need no locks. Their number stays: another one would deal sites, and their tracks, anew.
    """
    if not 0 <= worker < workers:
        raise ValueError("workers count from 0")
    others = [c for c in children(spark, folder) if c.startswith("worker=") and not c.endswith(f"-of-{workers}")]
    if others or (workers > 1 and path_exists(spark, f"{folder}/sites")):
        raise ValueError(f"{folder} is dealt to another number of workers")
    if workers == 1:
        return folder, sites
    return f"{folder}/worker={worker}-of-{workers}", sites.where(F.pmod(F.xxhash64("site_id"), F.lit(workers)) == worker)


def reprocess(spark: SparkSession, archive: str, out: str, site: str, start: datetime, end: datetime, sites: DataFrame, decoder: volumes.Decoder, make_scorer: Callable[[], Scorer], config: EngineConfig | None = None) -> engine.Processed:
    """A site's scans of a range of days again, oldest first with tracks of their own; results and detections as CSV."""
    config = config or EngineConfig()
    decoded = volumes.decode(volumes.archived(spark, archive, site, start.date(), end.date()), decoder)
    done = engine.process_scans(decoded.rays, decoded.volumes, sites, make_scorer, config)
    sinks.export_csv(done.results, f"{out}/results")
    sinks.export_csv(done.detections, f"{out}/detections")
    return done
