"""Score threshold and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewatch.config import EngineConfig


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def above_threshold(probability: Column, threshold: float | Column) -> Column:
    return probability >= threshold


def reasons(range_km: Column, n_gates: Column, edge_margin: Column, config: EngineConfig) -> Column:
    """Why a detection over the threshold isn't actionable, in fixed order."""
    low, few, edge = config.detection_min_range_km, config.detection_min_gates, config.min_heatmap_edge_margin
    found = F.array(
        F.when(range_km < low, F.format_string("range %.1fkm < %.1fkm", range_km, F.lit(low))),
        F.when(n_gates < few, F.format_string("n_gates %d < %d", n_gates, F.lit(few))),
        F.when(edge_margin < edge, F.format_string("heatmap edge margin %.3f < %.3f", edge_margin, F.lit(edge))),
    )
    return F.filter(found, lambda r: r.isNotNull())


def short_reasons(range_km: Column, n_gates: Column, edge_margin: Column, config: EngineConfig) -> Column:
    """The same flags in the wording of reports."""
    found = F.array(
        F.when(range_km < config.detection_min_range_km, F.format_string("range < %.0f km", F.lit(config.detection_min_range_km))),
        F.when(n_gates < config.detection_min_gates, F.format_string("gates < %d", F.lit(config.detection_min_gates))),
        F.when(edge_margin < config.min_heatmap_edge_margin, F.lit("edge max")),
    )
    return F.filter(found, lambda r: r.isNotNull())


def evaluate(rows: DataFrame, config: EngineConfig | None = None, threshold: float | Column | None = None) -> DataFrame:
    """Adds above_threshold, reasons (empty below the threshold), actionable."""
    config = config or EngineConfig()
    above = above_threshold(F.col("probability"), config.confidence_threshold if threshold is None else threshold)
    why = F.when(above, reasons(F.col("range_km"), F.col("n_gates"), F.col("edge_margin"), config)).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("above_threshold", above).withColumn("reasons", why).withColumn("actionable", above & (F.size("reasons") == 0))


def marker_class(above: Column, actionable: Column) -> Column:
    return F.when(actionable, "actionable").when(above, "gated").otherwise("below")
