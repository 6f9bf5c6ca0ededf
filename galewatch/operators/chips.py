"""Chips: fixed-size windows of all variables around a cell, two tilts deep, for a scoring model.

Windows are columns: which rays and gates belong to a cell is decided with built-in functions, and only those parts of
the arrays are shipped. NumPy resamples them inside Arrow batches; chips go straight to the scorer and aren't stored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewatch.config import EngineConfig
from galewatch.functions.bind import held
from galewatch.operators.cells import median_step
from galewatch.operators.sweeps import field_sweeps, sweep_table
from galewatch.schemas import FIELDS, VARIABLES

DEFAULT_SPACING_M, COORD_SCALE, COORD_PAD_M, COORD_LEAST_M = 250.0, 1e-5, 250.0, 2125.0
MODEL_KEYS = (*VARIABLES, "range_folded_mask", "coordinates")


def unwrapped(azimuth: Column, center: Column) -> Column:
    """The azimuth within half a turn of a centre, outside 0 to 360 where that needs it."""
    return center + F.pmod(azimuth - center + 180.0, F.lit(360.0)) - 180.0


def azimuth_window(azimuths: Column, center: Column, span: float) -> Column:
    """0-based positions of the rays within span/2 of a centre, both ends included, in the order of their unwrapped azimuth."""
    at = F.transform(azimuths, lambda a, i: F.struct(unwrapped(a, center).alias("u"), i.alias("i")))
    inside = F.filter(at, lambda s: (s["u"] >= center - span / 2) & (s["u"] <= center + span / 2))
    return F.transform(F.array_sort(inside), lambda s: s["i"])


def gate_spacing(range_m: Column) -> Column:
    return held(median_step(range_m), lambda step: F.when((step > 0) & (step < float("inf")), step).otherwise(F.lit(DEFAULT_SPACING_M)))


def range_window(range_m: Column, range_km: Column, span_m: float, most: int) -> Column:
    """struct<start, n, lower_m, upper_m>: gates centred on the nearest one and shifted, not cut, at the ends; n is 0
    where there are no gates."""
    gap = F.array_min(F.transform(range_m, lambda r, i: F.struct(F.abs(r - range_km * 1000.0).alias("gap"), i.alias("i"))))
    own = F.struct(range_m.alias("r"), F.size(range_m).alias("size"), gate_spacing(range_m).alias("spacing"), gap["i"].alias("nearest"))

    def placed(p: Column) -> Column:
        n = F.least(F.lit(most), F.greatest(F.lit(1), F.rint(F.lit(span_m) / p["spacing"]).cast("int")), p["size"])
        return held(F.struct(p.alias("p"), n.alias("n")), started)

    def started(q: Column) -> Column:
        start = F.greatest(F.least(q["p"]["nearest"] - F.floor(q["n"] / 2).cast("int"), q["p"]["size"] - q["n"]), F.lit(0))
        return held(F.struct(q["p"].alias("p"), q["n"].alias("n"), start.cast("int").alias("start")), bounded)

    def bounded(q: Column) -> Column:
        p = q["p"]
        lower = F.greatest(F.get(p["r"], q["start"]) - p["spacing"], F.lit(0.0))
        upper = F.get(p["r"], q["start"] + q["n"] - 1) + p["spacing"]
        return F.struct(q["start"].alias("start"), q["n"].cast("int").alias("n"), lower.alias("lower_m"), upper.alias("upper_m"))

    empty = F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0.0).alias("lower_m"), F.lit(0.0).alias("upper_m"))
    return F.when(F.coalesce(F.size(range_m), F.lit(0)) > 0, held(own, placed)).otherwise(empty)


def grid_positions(target: int, source: int) -> np.ndarray:
    return np.linspace(0.0, source - 1.0, target) if source > 1 else np.zeros(target)


def resampled(values: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Bilinear on a grid whose corners coincide; missing values count as 0 between others, and what lies nearest to a
    missing value is missing."""
    if values.shape == (rows, cols):
        return values
    if 0 in values.shape:
        return np.zeros((rows, cols), dtype=np.float32)
    y, x = grid_positions(rows, values.shape[0]), grid_positions(cols, values.shape[1])
    missing = np.isnan(values)
    clean = np.where(missing, 0.0, values).astype(np.float64)
    y0, x0 = np.minimum(np.floor(y).astype(int), max(values.shape[0] - 2, 0)), np.minimum(np.floor(x).astype(int), max(values.shape[1] - 2, 0))
    y1, x1 = np.minimum(y0 + 1, values.shape[0] - 1), np.minimum(x0 + 1, values.shape[1] - 1)
    wy, wx = (y - y0)[:, None], (x - x0)[None, :]
    top = clean[np.ix_(y0, x0)] * (1 - wx) + clean[np.ix_(y0, x1)] * wx
    bottom = clean[np.ix_(y1, x0)] * (1 - wx) + clean[np.ix_(y1, x1)] * wx
    out = top * (1 - wy) + bottom * wy
    out[missing[np.ix_(np.floor(y + 0.5).astype(int).clip(0, values.shape[0] - 1), np.floor(x + 0.5).astype(int).clip(0, values.shape[1] - 1))]] = np.nan
    return out.astype(np.float32)


def coordinates(lower_m: float, upper_m: float, rows: int, cols: int) -> np.ndarray:
    """Scaled range and its inverse, the same for every azimuth."""
    r = np.linspace((lower_m + COORD_PAD_M) * COORD_SCALE, (upper_m - COORD_PAD_M) * COORD_SCALE, cols)
    r = np.maximum(r, COORD_LEAST_M * COORD_SCALE)
    return np.broadcast_to(np.stack([r, 1.0 / r], axis=-1), (rows, cols, 2)).astype(np.float32)


def chip_parts(cells: DataFrame, rays: DataFrame, volumes: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """One row a cell: window bounds, and parts: array of struct<tilt, field, pos, ray_idx, gates> of the rays in the window.

    What a sweep is asked for (cells with windows and fields: a few numbers each) is gathered to one row and meets the
    rays once, whole as they are; the windows are cut out of the arrays there and then, and only these parts go on. A
    cell's parts are bounded by the chip (two tilts of six fields of a sixth of a turn).
    """
    config = config or EngineConfig()
    window = range_window(F.col("range_m"), F.col("range_km"), config.chip_range_m, config.chip_range_gates)
    own = cells.join(volumes.select("scan_key", "range_m"), "scan_key").withColumn("w", window).drop("range_m").where(F.col("w.n") > 0)
    sweeps, half = sweep_table(rays), config.chip_azimuth_span_deg / 2
    tilts = None
    for k, target in enumerate(config.target_elevations):
        chosen = field_sweeps(sweeps, target, config.split_cut_tolerance_deg)
        reference = F.coalesce(F.col("sweeps")["reflectivity"], F.get(F.map_values("sweeps"), F.lit(0)))
        fields = chosen.select("scan_key", F.lit(k).alias("tilt"), reference.alias("reference"), F.explode("sweeps").alias("field", "sweep_idx"))
        fields = fields.groupBy("scan_key", "sweep_idx", "tilt").agg(F.max(F.col("reference") == F.col("sweep_idx")).alias("is_reference"), F.collect_set("field").alias("fields"))
        tilts = fields if tilts is None else tilts.unionByName(fields)
    ask = F.struct("cell_id", "az_deg", F.col("w.start").alias("start"), F.col("w.n").alias("n"), "tilt", "is_reference", "fields")
    asked = own.select("scan_key", "cell_id", "az_deg", "w").join(tilts, "scan_key").groupBy("scan_key", "sweep_idx").agg(F.collect_list(ask).alias("asked"))

    gates = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("gates")) for f in FIELDS])
    pos = lambda a: unwrapped(F.col("azimuth_deg"), a["az_deg"])
    near = lambda a: F.abs(pos(a) - a["az_deg"]) <= half

    def cut(a: Column) -> Column:
        held_fields = F.filter(gates, lambda g: g["gates"].isNotNull() & F.array_contains(a["fields"], g["field"]))
        part = lambda g: F.struct(a["tilt"].alias("tilt"), g["field"].alias("field"), pos(a).alias("pos"), F.col("ray_idx"), F.slice(g["gates"], a["start"] + 1, a["n"]).alias("gates"))
        return F.struct(a["cell_id"].alias("cell_id"), a["tilt"].alias("tilt"), a["is_reference"].alias("is_reference"), F.transform(held_fields, part).alias("parts"))

    placed = rays.join(asked, ["scan_key", "sweep_idx"]).select(F.explode(F.transform(F.filter("asked", near), cut)).alias("p")).select("p.*")
    found = placed.groupBy("cell_id").agg(F.collect_list(F.struct("tilt", "is_reference", "parts")).alias("all"))
    # A tilt counts only where its reference sweep has rays in the window.
    usable = F.transform(F.filter("all", lambda x: x["is_reference"]), lambda x: x["tilt"])
    parts = held(F.array_distinct(usable), lambda tilts: F.array_sort(F.flatten(F.transform(F.filter("all", lambda x: F.array_contains(tilts, x["tilt"])), lambda x: x["parts"]))))
    found = found.select("cell_id", parts.alias("parts"))
    bounds = [(F.col("az_deg") - half).alias("az_lower"), (F.col("az_deg") + half).alias("az_upper"), F.col("w.lower_m").alias("range_lower_m"), F.col("w.upper_m").alias("range_upper_m")]
    return own.join(found, "cell_id", "left").select(*[c for c in cells.columns], *bounds, "parts")


def assembled(parts: list | None, lower_m: float, upper_m: float, config: EngineConfig) -> dict[str, np.ndarray]:
    """The model's arrays of one cell: [azimuth, range, tilt] each, without NaN."""
    rows, cols, tilts = config.chip_azimuth_bins, config.chip_range_gates, len(config.target_elevations)
    chip = {k: np.zeros((rows, cols, tilts), dtype=np.float32) for k in (*VARIABLES, "range_folded_mask")}
    names = {field: name for name, field in VARIABLES.items()}
    grouped: dict[tuple[int, str], list] = {}
    for p in [] if parts is None else parts:
        grouped.setdefault((p["tilt"], p["field"]), []).append(np.array([np.nan if x is None else x for x in p["gates"]], dtype=np.float32))
    for (tilt, field), lines in grouped.items():
        values = np.stack(lines)
        chip[names[field]][:, :, tilt] = resampled(values, rows, cols)
        if field == "velocity":
            chip["range_folded_mask"][:, :, tilt] = resampled(np.isnan(values).astype(np.float32), rows, cols)
    chip["coordinates"] = coordinates(lower_m, upper_m, rows, cols)
    return {k: np.nan_to_num(v, nan=0.0) for k, v in chip.items()}
