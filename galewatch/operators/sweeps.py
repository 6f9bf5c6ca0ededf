"""Choosing sweeps: by elevation, and by the fields that have data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewatch.schemas import FIELDS

SCAN = ["site", "scan_key"]


def field_rays(rays: DataFrame, field: str, sweep_idx: int = 0) -> DataFrame:
    return rays.where(F.col("sweep_idx") == sweep_idx).select(*SCAN, "ray_idx", "azimuth_deg", field)


def valid_gates(gates: Column) -> Column:
    return F.coalesce(F.size(F.filter(gates, lambda x: x.isNotNull())), F.lit(0))


def sweep_table(rays: DataFrame, keys: list[str] = SCAN) -> DataFrame:
    """One row a sweep: elevation of its first ray, and valid gates of each field. The rays are read once."""
    present = [f for f in FIELDS if f in rays.columns]
    return rays.groupBy(*keys, "sweep_idx").agg(
        F.min_by("elevation_deg", "ray_idx").alias("elevation_deg"), F.count("*").alias("n_rays"),
        *[F.sum(F.when(F.col(f).isNotNull(), valid_gates(F.col(f))).otherwise(0)).alias(f"valid_{f}") for f in present],
    )


def nearest_sweep(sweeps: DataFrame, target: float, tolerance: float = 0.3, keys: list[str] = SCAN) -> DataFrame:
    """The sweep nearest to an elevation, the first of equals; scans without one inside the tolerance have no row."""
    gap = F.abs(F.col("elevation_deg") - F.lit(target))
    best = sweeps.groupBy(*keys).agg(F.min(F.struct(gap.alias("gap"), F.col("sweep_idx"))).alias("b"))
    return best.where(F.col("b.gap") <= tolerance).select(*keys, F.col("b.sweep_idx").alias("sweep_idx"))


def field_sweeps(sweeps: DataFrame, target: float, tolerance: float = 0.5, keys: list[str] = SCAN) -> DataFrame:
    """For each scan a map from field to the first sweep near an elevation that has data for it.

    Surveillance and Doppler fields of one tilt often come in two sweeps.
    """
    present = [c.removeprefix("valid_") for c in sweeps.columns if c.startswith("valid_")]
    near = sweeps.where(F.abs(F.col("elevation_deg") - F.lit(target)) <= tolerance)
    first = near.groupBy(*keys).agg(*[F.min(F.when(F.col(f"valid_{f}") > 0, F.col("sweep_idx"))).alias(f) for f in present])
    entries = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in present]), lambda e: e["value"].isNotNull())
    return first.select(*keys, F.map_from_entries(entries).alias("sweeps")).where(F.size("sweeps") > 0)
