"""Where a model's heatmap peaks: position, margin to the edge, azimuth and range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galewatch.functions.geo import floor_mod


def argmax(heatmap: Column) -> Column:
    """0-based position of the first greatest value in row-major order; null where there is none."""
    clean = F.transform(heatmap, lambda x: F.when(~F.isnan(x), x))
    return (F.array_position(clean, F.array_max(clean)) - 1).cast("int")


def row_col(position: Column, cols: int) -> tuple[Column, Column]:
    return F.floor(position / cols).cast("int"), (position % cols).cast("int")


def edge_margin(row: Column, col: Column, rows: int, cols: int) -> Column:
    if rows <= 0 or cols <= 0:
        return F.when(row.isNotNull() & col.isNotNull(), F.lit(0.0))
    r, c = (row + 0.5) / F.lit(float(rows)), (col + 0.5) / F.lit(float(cols))
    return F.when(r.isNotNull() & c.isNotNull(), F.least(r, 1.0 - r, c, 1.0 - c))


def activation(row: Column, col: Column, rows: int, cols: int, az_lower: Column, az_upper: Column, range_lower_m: Column, range_upper_m: Column) -> tuple[Column, Column]:
    """Azimuth in [0, 360) and range in km of a heatmap cell's centre."""
    az = az_lower + (row + 0.5) / F.lit(float(rows)) * (az_upper - az_lower)
    r = range_lower_m + (col + 0.5) / F.lit(float(cols)) * (range_upper_m - range_lower_m)
    return floor_mod(az), r / 1000.0
