"""Summaries and the datasets behind maps and tables; drawing itself is left to other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galewatch.config import EngineConfig
from galewatch.functions.geo import destination, xy_polar
from galewatch.functions.tables import stored
from galewatch.functions.text import probability_label, short_label
from galewatch.operators.history import active_on, any_window_valid, located
from galewatch.operators.quality import marker_class, short_reasons

LABEL_OFFSETS = ((5, 5), (5, -10), (-26, 5), (-28, -10), (10, 14), (-36, 14), (12, -18), (-40, -18))  # fixed values: label places, taken in turn
TRACK_STATUS = ("valid - active latest scan", "valid - earlier in replay", "persistent model track", "pending/stale")


def scan_summary(cells: DataFrame, updates: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Per site and scan: candidates, over-threshold, pending, confirmed and newly confirmed ones, greatest probability.

    `scans` (site, scan_time) adds scans without candidates.
    """
    status = updates.select("site", "scan_time", "cand_idx", "status", "newly_confirmed")
    joined = cells.join(status, ["site", "scan_time", "cand_idx"], "left")
    found = joined.groupBy("site", "scan_time").agg(
        F.count("*").alias("n_cells"), F.count_if("above_threshold").alias("n_raw"), F.count_if(F.col("status") == "pending").alias("n_pending"),
        F.count_if(F.col("status").isin("confirmed", "newly_confirmed")).alias("n_confirmed"), F.count_if("newly_confirmed").alias("n_newly_confirmed"), F.max("probability").alias("max_prob"),
    )
    if scans is not None:
        found = scans.select("site", "scan_time").distinct().join(found, ["site", "scan_time"], "left")
    return found.select("site", "scan_time", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_cells", "n_raw", "n_pending", "n_confirmed", "n_newly_confirmed")], F.coalesce("max_prob", F.lit(0.0)).alias("max_prob"))


def replay_status(n_cells: Column, n_valid: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), F.concat(F.lit("parse_error: "), error)).when(n_cells == 0, "no_chips").when(n_valid == 0, "no_valid_chips").otherwise("processed")


def run_summary(cells: DataFrame) -> DataFrame:
    gated = F.col("above_threshold") & ~F.col("actionable")
    return cells.agg(F.count("*").alias("cells"), F.count_if("above_threshold").alias("over_threshold"), F.count_if(gated).alias("gated"), F.coalesce(F.max("probability"), F.lit(0.0)).alias("max_probability"))


def track_table(tracks: DataFrame, latest: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """TRACKS with counts, greatest probability, validity and status; `latest` is one row (latest_scan_time) per site."""
    config = config or EngineConfig()
    n, m = config.track_confirm_scans, config.track_confirm_window_scans
    real = F.filter("observations", lambda o: ~o["missed"])
    valid = F.col("confirmed_at").isNotNull() & any_window_valid(F.col("observations"), n, m)
    rows = tracks.join(latest.select("site", "latest_scan_time"), "site", "left")
    rows = rows.withColumns({
        "n_observations": F.size(real), "max_prob": F.coalesce(F.array_max(F.transform(real, lambda o: o["probability"])), F.lit(0.0)), "is_valid": valid,
        "is_active": active_on(F.col("observations"), F.col("confirmed_at"), F.col("latest_scan_time"), n, m), "misses": F.lit(0),
    }).drop("misses")
    status = F.when(F.col("is_active"), TRACK_STATUS[0]).when(F.col("is_valid"), TRACK_STATUS[1]).when(F.col("confirmed_at").isNotNull(), TRACK_STATUS[2]).otherwise(TRACK_STATUS[3])
    return rows.withColumn("status", status)


def track_order() -> list[Column]:
    """Confirmed tracks first, then by greatest probability."""
    return [F.col("confirmed_at").isNull(), F.desc("max_prob"), F.col("track_id")]


def numbered(rows: DataFrame, order: list[Column], column: str) -> DataFrame:
    """A table's rows with their place in an order, for tables that are shown whole.

    Places are counted by range partition, so that no task holds the table.
    """
    placed = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = placed.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_inside", inside).join(offsets, "_range").withColumn(column, (F.col("_before") + F.col("_inside")).cast("int")).drop("_range", "_inside", "_before")


def first_match(chosen: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """chosen with the first row, by order, of those of its key; none where there is no such row."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return chosen.join(first, key, "left").select(*chosen.columns, *[F.col("_first")[c].alias(c) for c in rest])


def replay_summary(per_scan: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row of totals over scan_summary and track_table."""
    a = per_scan.agg(F.count("*").alias("scans"), F.sum("n_raw").alias("raw_hits"))
    b = tracks.agg(F.count("*").alias("tracks"), F.count_if(F.col("confirmed_at").isNotNull()).alias("confirmed"), F.count_if("is_valid").alias("valid"), F.count_if("is_active").alias("active"), F.count_if(F.col("is_valid") & ~F.col("is_active")).alias("stale"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each


def track_paths(tracks: DataFrame, sites: DataFrame) -> DataFrame:
    """A row per located observation of a track, in order, with coordinates, and whether it starts or ends the path."""
    rows = tracks.select("track_id", "site", F.posexplode(located(F.col("observations"))).alias("step", "o"), F.size(located(F.col("observations"))).alias("n"))
    az, km = xy_polar(F.col("o.x_km"), F.col("o.y_km"))
    rows = rows.join(sites.select(F.col("site_id").alias("site"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "site")
    lat, lon = destination(F.col("_lat"), F.col("_lon"), az, km)
    return rows.select("track_id", "site", "step", F.col("o.scan_time").alias("scan_time"), F.col("o.probability").alias("probability"), lat.alias("lat"), lon.alias("lon"), (F.col("step") == 0).alias("is_start"), (F.col("step") == F.col("n") - 1).alias("is_end"))


def cell_markers(cells: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Cells with label, marker class, near-edge flag, and short reasons for maps."""
    config = config or EngineConfig()
    return cells.withColumns({
        "label": F.concat_ws(" ", short_label(F.col("cell_id")), probability_label(F.col("probability"))), "marker_class": marker_class(F.col("above_threshold"), F.col("actionable")),
        "near_edge": F.coalesce(F.col("edge_margin") < config.near_edge_margin, F.lit(False)),
        "gate_reasons": F.when(F.col("above_threshold"), short_reasons(F.col("range_km"), F.col("n_gates"), F.col("edge_margin"), config)).otherwise(F.array().cast("array<string>")),
    })


def label_offset(index: Column) -> Column:
    """struct<dx, dy>: eight places in turn."""
    return F.element_at(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in LABEL_OFFSETS]), (index % len(LABEL_OFFSETS) + 1).cast("int"))


def top_labels(rows: DataFrame, partition: list[str], order: list[Column], n: int = 12) -> DataFrame:
    """The first n rows of each partition, with their rank and label offset."""
    ranked = rows.withColumn("label_rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    return ranked.where(F.col("label_rank") <= n).withColumn("offset", label_offset(F.col("label_rank") - 1))


def places_inside(places: DataFrame, west: float, east: float, south: float, north: float, least_population: int, most: int = 30) -> DataFrame:
    """The most populous places of a map, ties by name."""
    inside = F.col("lon").between(west, east) & F.col("lat").between(south, north) & (F.coalesce("pop_max", F.lit(0)) >= least_population)
    return places.where(inside).orderBy(F.desc(F.coalesce("pop_max", F.lit(0))), "name").limit(most)


#: Places in the first stratum of populations at least; each further one reaches STRATUM_GROWTH times as many.
STRATUM, STRATUM_GROWTH = 10_000, 4


def population_strata(places: DataFrame, population: Column) -> list[tuple[int | None, int | None]]:
    """Ranges (from, below) of populations, the greatest first, that hold all places; None: without a bound."""
    n = places.count()
    shares = []
    while n / STRATUM_GROWTH ** (len(shares) + 1) >= STRATUM:
        shares.append(1.0 - STRATUM_GROWTH ** -(len(shares) + 1.0))
    if not shares:
        return [(None, None)]
    bounds = sorted(set(places.agg(F.percentile_approx(population, shares, 10_000)).first()[0]), reverse=True)
    return list(zip([*bounds, None], [None, *bounds]))


def places_on_maps(places: DataFrame, maps: DataFrame, least_population: int = 0, most: int = 30) -> DataFrame:
    """PLACES, and maps (map, west, east, south, north) -> map, place_rank and the place: each map's most populous places.

    A grid index joins the two by cell. A map goes to the level whose cells are as large as its longer side, so that it
    meets at most four of them whatever its size, and a place to its cell of every level that any map is on: a few numbers
    (sizes of maps differ by powers of two). A crowded cell is a skewed join, which Spark splits. Places are met in strata
    of population, the greatest first, and a map that is full meets no further one: work follows what maps show, not all
    places on them. A map whose west is beyond its east, or with a null bound, has no places.
    """
    population = F.coalesce("pop_max", F.lit(0))
    size = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(1e-6))
    asked = maps.where((F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north"))).withColumn("level", F.ceil(F.log2(size)).cast("int"))
    levels = [r["level"] for r in asked.select("level").distinct().collect()]  # exponents: some 30 at most
    cell = lambda x, level: F.floor(x / F.pow(F.lit(2.0), level))
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a), F.col("level")), cell(F.col(b), F.col("level"))))
    boxes = asked.withColumn("ix", span("west", "east")).withColumn("iy", span("south", "north"))
    known = places.where(population >= least_population)
    inside = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    order = Window.partitionBy("map").orderBy(F.desc(population), "name", "lon", "lat")

    def first(rows: DataFrame) -> DataFrame:
        return rows.withColumn("place_rank", F.row_number().over(order)).where(F.col("place_rank") <= most).select("map", "place_rank", "name", "lon", "lat", "pop_max")

    def met(own: DataFrame, left: DataFrame) -> DataFrame:
        own = own.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
        own = own.withColumn("ix", cell(F.col("lon"), F.col("level"))).withColumn("iy", cell(F.col("lat"), F.col("level")))
        return first(own.join(left, ["level", "ix", "iy"]).where(inside))

    strata, found, left = population_strata(known, population), None, boxes
    for low, below in strata[:-1]:
        own = known.where((population >= low) & (F.lit(True) if below is None else population < below))
        rows = stored(met(own, left), "places")
        found = rows if found is None else found.unionByName(rows)
        full = found.groupBy("map").agg(F.count("*").alias("_n")).where(F.col("_n") >= most).select("map")
        left = boxes.join(full, "map", "left_anti")
    low, below = strata[-1]
    rows = met(known if below is None else known.where(population < below), left)
    return rows if found is None else first(found.unionByName(rows))


def spaced_labels(labels: DataFrame, key: str, width: float, height: float) -> DataFrame:
    """Labels (key, rank, x, y, name) that overlap none of a better rank that was kept, map by map.

    A map's labels are at most those of places_inside; they are folded in order of rank inside one array.
    """
    fields = F.struct("rank", "x", "y", "name")
    own = labels.groupBy(key).agg(F.array_sort(F.collect_list(fields)).alias("all"))
    empty = F.array().cast(own.schema["all"].dataType)
    clash = lambda a, b: (F.abs(a["x"] - b["x"]) < width) & (F.abs(a["y"] - b["y"]) < height)
    kept = F.aggregate("all", empty, lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return own.select(key, F.explode(kept).alias("l")).select(key, "l.*")


#: Size of a quantile sketch, and gates of a scan up to which quantiles are exact. A rank of a sketch is off by 2.3 / size
#: ** 0.9 of the values (0.02 %), at 99 % confidence; a sketch is some 0.4 MB, whatever it has seen.
SKETCH = 1 << 15


def map_extent(gates: DataFrame, keys: list[str]) -> DataFrame:
    """Extent by scan: 0.1 and 99.9 percentiles of gate coordinates, padded by 5 % and a tenth of a degree at least.

    Large scans: every task sums its gates up into sketches, and sketches alone are shuffled and merged. Scans of up to
    SKETCH gates have exact quantiles, between two neighbouring values where a share falls between them.
    """
    axes, shares = ("lon", "lat"), (0.001, 0.999)
    known = gates.select(*keys, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in axes])
    sizes = known.groupBy(*keys).agg((F.count("*") <= SKETCH).alias("few"))
    marked = known.join(sizes, keys)
    exact = marked.where("few").groupBy(*keys).agg(*[F.percentile(c, list(shares)).alias(c) for c in axes])
    told = lambda c: F.array(*[F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(c, SKETCH), F.lit(q)) for q in shares])
    q = exact.unionByName(marked.where("not few").groupBy(*keys).agg(*[told(c).alias(c) for c in axes]))
    pad = lambda c: F.greatest((F.col(c)[1] - F.col(c)[0]) * 0.05, F.lit(0.1))
    return q.select(*keys, (F.col("lon")[0] - pad("lon")).alias("west"), (F.col("lon")[1] + pad("lon")).alias("east"), (F.col("lat")[0] - pad("lat")).alias("south"), (F.col("lat")[1] + pad("lat")).alias("north"))


def plot_gates(rays: DataFrame, volumes: DataFrame, cells: DataFrame, field: str = "reflectivity") -> DataFrame:
    """Gates of a field for a map: coordinates and values out to 300 km, or 40 km past the farthest cell."""
    reach = cells.groupBy("scan_key").agg(F.max("range_km").alias("far"))
    own = volumes.select("scan_key", "lat", "lon", "range_m").join(reach, "scan_key", "left")
    limit = F.greatest(F.lit(300.0), F.coalesce(F.col("far") + 40.0, F.lit(0.0)))
    gates = rays.join(own, "scan_key").select("scan_key", "azimuth_deg", "lat", "lon", limit.alias("limit"), F.explode(F.arrays_zip(F.col("range_m").alias("r"), F.col(field).alias("v"))).alias("g"))
    gates = gates.where(F.col("g.v").isNotNull() & (F.col("g.r") / 1000.0 <= F.col("limit")))
    lat, lon = destination(F.col("lat"), F.col("lon"), F.col("azimuth_deg"), F.col("g.r") / 1000.0)
    return gates.select("scan_key", "azimuth_deg", (F.col("g.r") / 1000.0).alias("range_km"), lat.alias("lat"), lon.alias("lon"), F.col("g.v").alias("value"))


def decision_flags(probability: Column, threshold: Column, above: Column, actionable: Column) -> tuple[Column, Column]:
    """Above-threshold and actionable; without a decision the score alone decides."""
    return F.coalesce(above, probability >= threshold), F.coalesce(actionable, above, probability >= threshold)


def padded(items: Column, n: int, kind: str) -> Column:
    """An array cut or filled with nulls to n items."""
    return F.slice(F.concat(F.coalesce(items, F.array().cast(f"array<{kind}>")), F.array_repeat(F.lit(None).cast(kind), n)), 1, n)


def overlay_hits(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """Over-threshold cells with their centroid and the point of the model's peak, the centroid where there is none."""
    rows = cells.where("above_threshold").join(sites.select(F.col("site_id").alias("site"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "site")
    lat, lon = destination(F.col("_lat"), F.col("_lon"), F.col("az_deg"), F.col("range_km"))
    alat, alon = destination(F.col("_lat"), F.col("_lon"), F.col("activation_az_deg"), F.col("activation_range_km"))
    rows = rows.withColumns({"lat": lat, "lon": lon, "hit_lat": alat, "hit_lon": alon}).drop("_lat", "_lon")
    return rows.withColumn("hit_lat", F.coalesce("hit_lat", "lat")).withColumn("hit_lon", F.coalesce("hit_lon", "lon"))


def highlight(kind: str) -> Column:
    """Row classes of the tables: cells by marker, scans by what was found, tracks by status."""
    if kind == "cells":
        return F.col("marker_class")
    if kind == "scans":
        return F.when(F.col("n_newly_confirmed") > 0, "new").when(F.col("n_confirmed") > 0, "confirmed").when(F.col("n_raw") > 0, "raw").otherwise("plain")
    return F.when(F.col("status") == TRACK_STATUS[0], "active").when(F.col("status") == TRACK_STATUS[1], "valid").when(F.col("status") == TRACK_STATUS[2], "persistent").otherwise("plain")


def stage_times(timings: DataFrame) -> DataFrame:
    """scan_key, stage, seconds -> the same with the scan's total and whether a stage was its longest."""
    by = Window.partitionBy("scan_key")
    return timings.withColumn("total", F.sum("seconds").over(by)).withColumn("is_longest", F.col("seconds") == F.max("seconds").over(by))
