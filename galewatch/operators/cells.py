"""Storm cells: convective gates, connected clusters, centroids and azimuthal shear."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galewatch.config import EngineConfig
from galewatch.functions.bind import held
from galewatch.functions.geo import circular_gap
from galewatch.functions.text import cell_id
from galewatch.operators.sweeps import field_sweeps, nearest_sweep, sweep_table


def near_gates(range_m: Column, min_range_km: float) -> Column:
    """Number of gates nearer than the limit."""
    return F.size(F.filter(range_m, lambda r: r / 1000.0 < min_range_km))


def convective_gates(rays: DataFrame, volumes: DataFrame, config: EngineConfig, field: str = "reflectivity") -> DataFrame:
    """scan_key, ray_idx, gate_idx, dbz of gates at or over the threshold, beyond the near range.

    Gates are cut down inside the ray's array, before they become rows.
    """
    near = volumes.select("scan_key", near_gates(F.col("range_m"), config.cell_min_range_km).alias("near"))
    kept = F.filter(F.transform(field, lambda x, i: F.struct(i.alias("gate_idx"), x.cast("double").alias("dbz"))), lambda g: (g["dbz"] >= config.cell_dbz_threshold) & (g["gate_idx"] >= F.col("near")))
    return rays.join(near, "scan_key").select("scan_key", "ray_idx", F.explode(kept).alias("g")).select("scan_key", "ray_idx", "g.*")


def labelled(ray: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Cluster numbers from 1 of grid points joined through shared edges, in raster order of their first points.

    No link across the last and first ray.
    """
    n = len(ray)
    order = np.lexsort((gate, ray))
    r, g = ray[order].astype(np.int64), gate[order].astype(np.int64)
    width = int(g.max(initial=0)) + 2
    flat = r * width + g
    side = np.flatnonzero(flat[1:] == flat[:-1] + 1)
    below = np.searchsorted(flat, flat + width)
    up = np.flatnonzero(flat[np.minimum(below, n - 1)] == flat + width)
    a, b = np.r_[side, up], np.r_[side + 1, below[up]]
    first = np.arange(n)
    while len(a):
        low = np.minimum(first[a], first[b])
        new = first.copy()
        np.minimum.at(new, first[a], low)
        np.minimum.at(new, first[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, first):
            break
        first = new
    out = np.empty(n, dtype=np.int64)
    out[order] = np.unique(first, return_inverse=True)[1] + 1
    return out


def label_gates(gates: DataFrame, key: str = "scan_key") -> DataFrame:
    """Adds label. A group is one sweep's convective gates, which the radar's resolution bounds."""
    schema = ", ".join(f"{n} {t}" for n, t in gates.dtypes) + ", label int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(label=labelled(rows["ray_idx"].to_numpy(), rows["gate_idx"].to_numpy()))

    return gates.groupBy(key).applyInPandas(run, schema)


def clusters(gates: DataFrame, min_gates: int, key: str = "scan_key") -> DataFrame:
    """key, label, n_gates, dbz_max, az_center_idx, range_center_idx. Centres round half to even."""
    found = gates.groupBy(key, "label").agg(F.count("*").cast("int").alias("n_gates"), F.max("dbz").alias("dbz_max"), F.rint(F.avg("ray_idx")).cast("int").alias("az_center_idx"), F.rint(F.avg("gate_idx")).cast("int").alias("range_center_idx"))
    return found.where(F.col("n_gates") >= min_gates)


def rank_cells(cells: DataFrame, key: str = "scan_key") -> DataFrame:
    """Adds cand_idx: by peak reflectivity, strongest first, ties by label."""
    return cells.withColumn("cand_idx", (F.row_number().over(Window.partitionBy(key).orderBy(F.desc("dbz_max"), "label")) - 1).cast("int"))


def median_step(values: Column) -> Column:
    """Median difference of neighbours in an array; null where there are fewer than two."""
    n = F.size(values) - 1
    steps = F.zip_with(F.slice(values, 2, n), F.slice(values, 1, n), lambda b, a: b - a)
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2.0
    return F.when(n >= 1, held(F.array_sort(steps), middle))


def azimuthal_shear(cells: DataFrame, rays: DataFrame, volumes: DataFrame, sweep_of: DataFrame, config: EngineConfig) -> DataFrame:
    """cells (scan_key, cell_id, az_deg, range_km) with shear: the largest step of velocity between neighbouring rays
    around the cell, over the distance of the rays there.

    Rays meet a scan's cells by scan_key, so their arrays move once, and only the 21 rays and 21 gates around a cell go
    on from there. 0 where there is no velocity.
    """
    half, wide = config.shear_half_rays, config.shear_half_gates
    chosen = sweep_of.select("scan_key", F.col("sweeps")["velocity"].alias("_sweep"))
    velocity = rays.join(chosen, "scan_key").where(F.col("sweep_idx") == F.col("_sweep")).select("scan_key", "ray_idx", "azimuth_deg", "velocity")
    sweep = velocity.groupBy("scan_key").agg(F.array_sort(F.collect_list(F.struct("ray_idx", "azimuth_deg"))).alias("own")).select("scan_key", F.col("own.azimuth_deg").alias("azimuths"), F.col("own.ray_idx").alias("indices"))
    placed = cells.select("scan_key", "cell_id", "az_deg", "range_km").join(sweep, "scan_key").join(volumes.select("scan_key", F.transform("range_m", lambda r: r / 1000.0).alias("km")), "scan_key")
    nearest = lambda a, gap: F.array_min(F.transform(a, lambda x, i: F.struct(gap(x).alias("gap"), i.alias("i"))))["i"]
    placed = placed.withColumn("center", nearest(F.col("azimuths"), lambda x: circular_gap(x, F.col("az_deg")))).withColumn("gate", nearest(F.col("km"), lambda x: F.abs(x - F.col("range_km"))))
    n = F.size("azimuths")
    spacing = F.coalesce(median_step(F.col("azimuths")), F.lit(1.0))
    distance = F.greatest(F.col("range_km") * F.radians(spacing), F.lit(0.01))
    window = placed.select("scan_key", "cell_id", distance.alias("distance"), "gate", n.alias("n"), F.col("indices"), F.col("center"), F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("k"))
    window = window.select("scan_key", "cell_id", "distance", "gate", "k", F.get("indices", F.pmod(F.col("center") + F.col("k"), F.col("n"))).alias("ray_idx"))
    # A scan's windows as a map from ray to cells: bounded by its cells.
    by_ray = window.groupBy("scan_key", "ray_idx").agg(F.collect_list(F.struct("cell_id", "distance", "gate", "k")).alias("w"))
    by_scan = by_ray.groupBy("scan_key").agg(F.map_from_entries(F.collect_list(F.struct("ray_idx", "w"))).alias("at"))
    joined = velocity.join(by_scan, "scan_key").select("scan_key", "velocity", F.explode(F.try_element_at("at", F.col("ray_idx"))).alias("w"))
    low = F.greatest(F.col("w.gate") - wide, F.lit(0))
    joined = joined.select("scan_key", "w.cell_id", "w.distance", "w.k", F.slice("velocity", low + 1, F.col("w.gate") + wide + 1 - low).alias("v"))
    previous = F.lag("v").over(Window.partitionBy("scan_key", "cell_id").orderBy("k"))
    steps = F.array_max(F.zip_with("v", "before", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    shear = joined.withColumn("before", previous).groupBy("scan_key", "cell_id").agg((F.max(steps) / F.first("distance")).alias("shear"))
    return cells.join(shear, ["scan_key", "cell_id"], "left").withColumn("shear", F.coalesce("shear", F.lit(0.0)))


def identify_cells(rays: DataFrame, volumes: DataFrame, config: EngineConfig | None = None, elevation_deg: float = 0.5) -> DataFrame:
    """RAYS, VOLUMES -> one row a storm cell, with shear and cand_idx."""
    config = config or EngineConfig()
    sweeps = sweep_table(rays)
    chosen = nearest_sweep(sweeps, elevation_deg, config.sweep_tolerance_deg)
    own = rays.join(chosen, ["site", "scan_key", "sweep_idx"])
    gates = convective_gates(own.where(F.col("reflectivity").isNotNull()), volumes, config)
    found = clusters(label_gates(gates), config.cell_min_gates)
    at_ray = own.select("scan_key", F.col("ray_idx").alias("az_center_idx"), F.col("azimuth_deg").alias("az_deg"))
    at_gate = volumes.select("site", "scan_key", "range_m")
    cells = found.join(at_ray, ["scan_key", "az_center_idx"]).join(at_gate, "scan_key").withColumn("range_km", F.get("range_m", F.col("range_center_idx")) / 1000.0).drop("range_m")
    cells = cells.withColumn("cell_id", cell_id(F.col("scan_key"), F.col("label")))
    cells = azimuthal_shear(cells, rays, volumes, field_sweeps(sweeps, elevation_deg, config.split_cut_tolerance_deg), config)
    if config.shear_threshold > 0:
        cells = cells.where(F.col("shear") >= config.shear_threshold)
    columns = ["site", "scan_key", "cell_id", "label", "az_deg", "range_km", "az_center_idx", "range_center_idx", "dbz_max", "n_gates", "shear"]
    return rank_cells(cells.select(*columns))
