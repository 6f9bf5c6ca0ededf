"""The radar site catalog: base table, overrides, names and time zones."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galewatch.functions.tables import path_exists
from galewatch.functions.text import site_key
from galewatch.sources.site_tables import CORE_SITES, SITE_NAMES, SITE_TIMEZONES, STATE_TIMEZONES

MISSING_ELEVATION = -99999


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), key)


def is_terminal_site(site_id: Column) -> Column:
    """Airport terminal radars start with T; TJUA is a weather radar all the same."""
    return site_id.startswith("T") & (site_id != "TJUA")


def display_name(site_id: Column) -> Column:
    return F.coalesce(_lookup(SITE_NAMES, site_id), site_id)


def site_timezone(site_id: Column) -> Column:
    """The site's own zone, else its state's, else UTC."""
    name = _lookup(SITE_NAMES, site_id)
    return F.coalesce(_lookup(SITE_TIMEZONES, site_id), _lookup(STATE_TIMEZONES, F.substring_index(name, ", ", -1)), F.lit("UTC"))


def elevation_ft(elev: Column) -> Column:
    return F.when(elev != MISSING_ELEVATION, F.rint(elev).cast("int"))


def core_sites(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(CORE_SITES, "site_id string, lat double, lon double, elev_ft int, name string")
    return rows.withColumn("timezone", site_timezone(F.col("site_id")))


def base_catalog(locations: DataFrame, include_terminal: bool = False) -> DataFrame:
    """site_id, lat, lon, elev -> the columns of SITES."""
    rows = locations if include_terminal else locations.where(~is_terminal_site(F.col("site_id")))
    key = F.col("site_id")
    return rows.select("site_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), elevation_ft(F.col("elev")).alias("elev_ft"), display_name(key).alias("name"), site_timezone(key).alias("timezone"))


def read_locations(spark: SparkSession, path: str) -> DataFrame | None:
    """A location table (site_id, lat, lon, elev) from Parquet, CSV with a header, or a text in which sites stand as
    'KABC': {'lat': 1.5, 'lon': -2.5, 'elev': 300}, such as JSON or a module's source; None where the file isn't there or
    has no site. A missing elevation is null; of repeated sites the last one counts.
    """
    if not path_exists(spark, path):
        return None
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "csv"):
        rows = spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", "true").csv(path)
        rows = rows.select("site_id", *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "elev")])
    else:
        found = F.regexp_extract_all("value", F.lit(r"""['"][A-Z0-9]{4}['"]\s*+:\s*+\{[^{}]*+\}"""), F.lit(0))
        entries = spark.read.text(path, wholetext=True).select(F.posexplode(found).alias("place", "entry"))
        number = lambda c: F.regexp_extract("entry", rf"""['"]{c}['"]\s*+:\s*+(-?[0-9.]++)""", 1).try_cast("double").alias(c)
        rows = entries.select(F.substring("entry", 2, 4).alias("site_id"), "place", number("lat"), number("lon"), number("elev"))
        rows = rows.groupBy("site_id").agg(F.max_by(F.struct("lat", "lon", "elev"), "place").alias("l")).select("site_id", "l.*")
    rows = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return None if rows.isEmpty() else rows


def overlaid(base: DataFrame, overrides: DataFrame, key: str = "site_id") -> DataFrame:
    """Full outer merge: an override's column counts where it isn't null, the base's elsewhere."""
    columns = [c for c in base.columns if c != key]
    a = base.select(key, *[F.col(c).alias(f"_base_{c}") for c in columns])
    b = overrides.select(key, *[(F.col(c) if c in overrides.columns else F.lit(None)).alias(f"_own_{c}") for c in columns])
    return a.join(b, key, "full").select(key, *[F.coalesce(f"_own_{c}", f"_base_{c}").alias(c) for c in columns])


def build_catalog(spark: SparkSession, locations: DataFrame | None = None, overrides: DataFrame | None = None, include_terminal: bool = False) -> DataFrame:
    """The SITES table, by site_id. Without a location table the core sites stand alone."""
    core = core_sites(spark)
    base = core if locations is None else base_catalog(locations, include_terminal)
    merged = overlaid(base, core if overrides is None else overrides)
    key = F.col("site_id")
    return merged.withColumn("name", F.coalesce("name", key)).withColumn("timezone", F.coalesce("timezone", site_timezone(key))).orderBy("site_id")


def distinct_in_order(rows: DataFrame, column: str, position: str) -> DataFrame:
    """Distinct normalised names in the order of their first position."""
    return rows.select(site_key(F.col(column)).alias(column), position).where(F.col(column) != "").groupBy(column).agg(F.min(position).alias(position)).orderBy(position)


def unknown_sites(requested: DataFrame, sites: DataFrame) -> DataFrame:
    return requested.join(sites.select("site_id"), requested["site"] == sites["site_id"], "left_anti")


def require_known(requested: DataFrame, sites: DataFrame) -> DataFrame:
    """The requested rows; raises where a site isn't in the catalog."""
    wrong = [r["site"] for r in unknown_sites(requested, sites).orderBy("site").limit(20).collect()]
    if wrong:
        raise ValueError(f"unknown radar sites: {', '.join(wrong)}")
    return requested


def with_coordinates(rows: DataFrame, sites: DataFrame, site: str = "site") -> DataFrame:
    """Adds site_lat, site_lon of the catalog; rows of unknown sites go (inner join on a small dimension)."""
    dim = sites.select(F.col("site_id").alias("_site"), F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"))
    return rows.join(dim, F.col(site) == F.col("_site")).drop("_site")


def volume_coordinates(volumes: DataFrame, sites: DataFrame) -> DataFrame:
    """Volumes with lat and lon from the catalog where the volume's own are both near zero."""
    dim = sites.select(F.col("site_id").alias("site"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    blank = (F.abs("lat") < 1.0) & (F.abs("lon") < 1.0) & F.col("_lat").isNotNull()
    fixed = volumes.join(dim, "site", "left")
    return fixed.withColumns({c: F.when(blank, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("lat", "lon")}).select(*volumes.columns)


def listing(sites: DataFrame) -> DataFrame:
    """One tab-separated line a site, by site_id."""
    line = F.format_string("%s\t%.5f\t%.5f\t%s", "site_id", "lat", "lon", "name")
    return sites.orderBy("site_id").select(line.alias("line"))


def with_position(rows: DataFrame, order: list[Column], partition: list[str]) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)
