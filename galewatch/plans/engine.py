"""The engine's life cycles over DataFrames: one pass over scans, replay, streams and the schedule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewatch.config import EngineConfig
from galewatch.functions.tables import stored
from galewatch.operators.cells import identify_cells
from galewatch.operators.chips import chip_parts
from galewatch.operators.quality import evaluate
from galewatch.operators.scoring import Scorer, score
from galewatch.plans.measured import Stages
from galewatch.sources.volumes import newest_unprocessed
from galewatch.streaming import tracker
from galewatch.streaming.sinks import detections_table, results_table


@dataclass(frozen=True)
class Processed:
    """What a pass over scans yields: scored cells, tracking updates, and the two log tables."""

    cells: DataFrame
    updates: DataFrame
    results: DataFrame
    detections: DataFrame


def scored_cells(rays: DataFrame, volumes: DataFrame, make_scorer: Callable[[], Scorer], config: EngineConfig | None = None, stages: Stages | None = None) -> DataFrame:
    """RAYS, VOLUMES -> cells with score, quality flags and rank: segmentation, chips and scoring without stops between
    (with stages, segmentation is stored and measured by itself)."""
    config = config or EngineConfig()
    cells = identify_cells(rays, volumes, config)
    cells = stages.stored(cells, "identified") if stages else cells
    scored = evaluate(score(chip_parts(cells, rays, volumes, config), make_scorer, config), config)
    times = volumes.select("scan_key", "scan_time")
    return scored.join(times, "scan_key").withColumn("threshold", F.lit(config.confidence_threshold)).withColumn("quality_pass", F.col("actionable"))


def process_scans(rays: DataFrame, volumes: DataFrame, sites: DataFrame, make_scorer: Callable[[], Scorer], config: EngineConfig | None = None, stages: Stages | None = None) -> Processed:
    """All scans given, oldest first; each site's tracks run through them.

    Cells and updates are stored, so that writing the tables that follow from them runs neither the model nor the
    tracker again. With stages, every table is, and stages.table() has the seconds and rows of each.
    """
    config = config or EngineConfig()
    keep = stages.stored if stages else stored
    cells = keep(scored_cells(rays, volumes, make_scorer, config, stages), "scored")
    updates = keep(tracker.replay(tracker.scans_of(cells, volumes.select("site", "scan_key", "scan_time")), config), "tracked")
    results, detections = results_table(cells, sites), detections_table(cells, updates, sites)
    if stages:
        results, detections = stages.stored(results, "results"), stages.stored(detections, "detections")
    return Processed(cells, updates, results, detections)


def due_scans(catalog: DataFrame, processed: DataFrame, queue: DataFrame) -> DataFrame:
    """The newest unprocessed scan of every site that is due (schedule.due_queue), in the order in which sites are due.

    One job takes all due sites at once: tasks are the workers, and no two hold the same site.
    """
    due = queue.where("due").select("site", "due_at", "priority")
    return newest_unprocessed(catalog, processed).join(due, "site").orderBy("due_at", "priority", "site")


def attempts_of(outcomes: DataFrame, queue: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """What became of every due site, as ATTEMPTS without seq: outcomes by site, failed volumes, and sites without a new scan."""
    counts = ("cells_found", "chips_processed", "raw_detections", "detections")
    own = outcomes.select("site", "status", *counts)
    if errors is not None:
        own = own.unionByName(errors.select("site", F.lit("error").alias("status"), *[F.lit(0).alias(c) for c in counts]).distinct())
    rest = queue.where("due").select("site").join(own.select("site"), "site", "left_anti")
    return own.unionByName(rest.select("site", F.lit("no_new_scan").alias("status"), *[F.lit(0).alias(c) for c in counts]))


def scan_outcomes(volumes: DataFrame, cells: DataFrame, scored: DataFrame, updates: DataFrame) -> DataFrame:
    """One row a scan: status, cells found, chips processed, raw detections, pending tracks, detections."""
    found = cells.groupBy("scan_key").agg(F.count("*").cast("int").alias("cells_found"))
    chips = scored.groupBy("scan_key").agg(F.count("*").cast("int").alias("chips_processed"), F.count_if("above_threshold").cast("int").alias("raw_detections"))
    tracked = updates.groupBy("site", "scan_time").agg(F.count_if(F.col("status") == "pending").cast("int").alias("pending_tracks"), F.count_if("newly_confirmed").cast("int").alias("detections"))
    rows = volumes.select("site", "scan_key", "scan_time").join(found, "scan_key", "left").join(chips, "scan_key", "left").join(tracked, ["site", "scan_time"], "left")
    rows = rows.fillna(0, ["cells_found", "chips_processed", "raw_detections", "pending_tracks", "detections"])
    status = F.when(F.col("cells_found") == 0, "no_cells").when(F.col("chips_processed") == 0, "no_chips").otherwise("processed")
    return rows.withColumn("status", status)


def stream_scans(scans: DataFrame, path: str, checkpoint: str, config: EngineConfig | None = None, once: bool = True):
    """Runs the tracker over a stream of SCANS into a folder; started again it goes on where it stopped."""
    from galewatch.streaming.sinks import idempotent

    config = config or EngineConfig()
    writer = tracker.stream(scans, config, expire=not once).writeStream.option("checkpointLocation", checkpoint).foreachBatch(idempotent(path))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{config.poll_interval_seconds} seconds")
    return writer.start()
