"""Result and detection tables: their columns, and appends that a repeated micro-batch doesn't double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewatch.functions.geo import destination
from galewatch.functions.text import iso_utc, joined_reasons
from galewatch.sources.sites import with_coordinates


def rounded(column: str, digits: int):
    return F.bround(column, digits).alias(column)


def results_table(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """Scored cells (site, scan_time, cell_id, az_deg, range_km, dbz_max, n_gates, probability, above_threshold) as the
    eleven columns of the results log, placed by the catalog's coordinates."""
    lat, lon = destination(F.col("site_lat"), F.col("site_lon"), F.col("az_deg"), F.col("range_km"))
    rows = with_coordinates(cells, sites).withColumn("lat", lat).withColumn("lon", lon)
    said = F.when(F.col("above_threshold"), "True").otherwise("False").alias("above_threshold")
    return rows.select(iso_utc(F.col("scan_time")).alias("scan_time"), "site", "cell_id", rounded("az_deg", 2), rounded("range_km", 2), rounded("lat", 5), rounded("lon", 5), rounded("dbz_max", 1), "n_gates", rounded("probability", 6), said)


def detections_table(cells: DataFrame, updates: DataFrame, sites: DataFrame) -> DataFrame:
    """One row for each newly confirmed track, with the cell that confirmed it: the columns of the detections log."""
    real = F.filter("observations", lambda o: ~o["missed"])
    new = updates.where("newly_confirmed").select(
        "cell_id", "track_id", "created_at", F.coalesce("confirmed_at", "scan_time").alias("confirmed_at"), F.col("scan_time").alias("latest"), "hits_in_window", F.col("window_size").alias("confirmation_window"),
        F.size(real).alias("observations"), F.coalesce(F.array_max(F.transform(real, lambda o: o["probability"])), F.lit(0.0)).alias("max_probability"),
    )
    lat, lon = destination(F.col("site_lat"), F.col("site_lon"), F.col("az_deg"), F.col("range_km"))
    rows = with_coordinates(cells.join(new, "cell_id"), sites).withColumn("lat", lat).withColumn("lon", lon)
    return rows.select(
        iso_utc(F.col("confirmed_at")).alias("confirmed_at"), "site", "track_id", iso_utc(F.col("created_at")).alias("first_seen"), iso_utc(F.col("latest")).alias("latest_scan_time"), "cell_id", rounded("probability", 6), rounded("max_probability", 6),
        "hits_in_window", "confirmation_window", "observations", rounded("az_deg", 2), rounded("range_km", 2), rounded("lat", 5), rounded("lon", 5), rounded("dbz_max", 1), "n_gates", rounded("shear", 3), "quality_pass",
        joined_reasons(F.col("reasons")).alias("quality_reasons"), rounded("activation_az_deg", 2), rounded("activation_range_km", 2), F.bround("edge_margin", 4).alias("heatmap_edge_margin"),
    )


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def idempotent(path: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every micro-batch overwrites a folder of its own number, so a repeat replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
