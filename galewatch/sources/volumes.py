"""Scan listings and volumes. The binary format is behind a decoder that callers supply; Spark lists, reads and prunes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galewatch.functions import phase
from galewatch.functions.tables import stored
from galewatch.functions.text import scan_date_from_filename, scan_key, site_key
from galewatch.schemas import FIELDS, RAYS
from galewatch.sources import archive

#: path, content -> rows of RAYS without site and scan_key; in the volume's first row at least scan_time, lat, lon, range_m.
Decoder = Callable[[str, bytes], pd.DataFrame]
HEADS = "scan_time timestamp, lat double, lon double, range_m array<double>"


class Decoded(NamedTuple):
    rays: DataFrame  # RAYS
    volumes: DataFrame  # VOLUMES
    failed: DataFrame  # path, site, scan_key, error


def is_volume(filename: Column, key: Column) -> Column:
    """Metadata objects end in _MDM; an object without a name goes by its key."""
    return ~F.coalesce(F.when(filename != "", filename), key).endswith("_MDM")


def list_scans(catalog: DataFrame, site: str, start, end=None) -> DataFrame:
    """The volumes of a site for a day, or a range of days, in listing order."""
    days = F.col("scan_date").between(F.lit(start).cast("date"), F.lit(end if end is not None else start).cast("date"))
    return catalog.where((F.col("site") == site.strip().upper()) & days & is_volume(F.col("filename"), F.col("key"))).orderBy("scan_date", "ord")


def latest_scans(catalog: DataFrame) -> DataFrame:
    """The last volume of each site in listing order."""
    last = F.max_by(F.struct(*catalog.columns), F.struct("scan_date", "ord"))
    return catalog.where(is_volume(F.col("filename"), F.col("key"))).groupBy("site").agg(last.alias("s")).select("s.*")


def newest_unprocessed(catalog: DataFrame, processed: DataFrame) -> DataFrame:
    """For each site the newest volume whose key isn't in processed (key)."""
    return latest_scans(catalog.join(processed.select("key").distinct(), "key", "left_anti").select(*catalog.columns))


def scan_by_filename(catalog: DataFrame, filename: str) -> DataFrame:
    """The volume of that name; its day is read from the name, which prunes partitions."""
    day = scan_date_from_filename(F.lit(filename))
    return catalog.where((F.col("scan_date") == day) & (F.col("filename") == filename))


def scan_range(catalog: DataFrame, first: int, last: int) -> DataFrame:
    return catalog.where(F.col("ord").between(first, last)).orderBy("ord")


def site_of_upload(filename: Column) -> Column:
    """The first four characters, where they are letters."""
    head = F.substring(F.upper(filename), 1, 4)
    return F.when(head.rlike("^[A-Z]{4}$"), head)


def read_catalog(spark: SparkSession, root: str, sites: list[str] | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    """SCAN_CATALOG of a folder of volumes: names alone are read, not contents.

    With sites and days the folders root/yyyy/mm/dd/site are listed, as archives lay them out, each by the executor that
    has it, and no others; without them everything below root.
    """
    if sites is None or start is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    elif not sites:
        files = spark.createDataFrame([], "path string")
    else:
        archive.register(spark)
        asked = {"path": root, "contents": "false", "sites": ",".join(s.strip().upper() for s in sites), "start": f"{start}", "end": f"{end or start}"}
        files = spark.read.format(archive.NAME).options(**asked).load().select(F.col("key").alias("path"))
    name = F.substring_index("path", "/", -1)
    rows = files.select(site_key(F.substring(name, 1, 4)).alias("site"), scan_date_from_filename(name).alias("scan_date"), F.col("path").alias("key"), name.alias("filename"))
    return rows.withColumn("ord", (F.row_number().over(Window.partitionBy("site", "scan_date").orderBy("filename")) - 1).cast("int"))


def archived(spark: SparkSession, root: str, site: str, start: date, end: date) -> DataFrame:
    """site, scan_key, path, content of a site's volumes of a range of days, for decode. No name passes through the driver."""
    archive.register(spark)
    files = spark.read.format(archive.NAME).option("path", root).load().where((F.col("site") == site.strip().upper()) & F.col("scan_date").between(F.lit(start), F.lit(end)))
    return named_files(files.where(is_volume(F.col("filename"), F.col("key"))).select(F.col("key").alias("path"), "content"))


def named_files(files: DataFrame) -> DataFrame:
    """path, content -> site, scan_key, path, content: site and time are read from the name."""
    name = F.substring_index("path", "/", -1)
    stamp = F.to_timestamp(F.regexp_extract(name, r"([0-9]{8}_[0-9]{6})", 1), "yyyyMMdd_HHmmss")
    site = site_key(F.substring(name, 1, 4))
    return files.select(site.alias("site"), scan_key(site, stamp).alias("scan_key"), "path", "content")


def contents(spark: SparkSession, scans: DataFrame) -> DataFrame:
    """SCAN_CATALOG rows -> site, scan_key, path, content, for decode: the chosen volumes are read, and no others.

    For rounds, which take a volume per site: the names of the chosen ones go through the driver. A range of days is read by
    `archived`.
    """
    paths = [r["key"] for r in scans.select("key").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "site string, scan_key string, path string, content binary")
    return named_files(spark.read.format("binaryFile").load(paths).select("path", "content"))


def decode(files: DataFrame, decoder: Decoder) -> Decoded:
    """site, scan_key, path, content -> rays, volumes, and the files that couldn't be read.

    A volume is one row; Spark bounds the bytes of a batch (spark.sql.execution.arrow.maxBytesPerBatch). A failure costs
    its own volume only: it goes to the second table and yields no scan. Volumes are decoded once, into a stored table.
    Where a volume has differential_phase but no specific differential phase, that is derived (functions.phase).
    """
    names, heads = ([c.split()[0] for c in x.split(", ")] for x in (RAYS, HEADS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                try:
                    rays, error = phase.filled(decoder(row.path, row.content)), None
                except Exception as wrong:  # whatever a decoder raises is about this volume
                    rays, error = pd.DataFrame(index=[0]), f"{type(wrong).__name__}: {wrong}"
                own = rays.assign(site=row.site, scan_key=row.scan_key, error=error, path=row.path)
                for name in {*names, *heads} - set(own.columns):
                    own[name] = None
                yield own[[*names, *heads, "error", "path"]]

    rows = files.select("site", "scan_key", "path", "content").mapInPandas(run, f"{RAYS}, {HEADS}, error string, path string")
    rows = stored(rows, "decoded")
    good = rows.where(F.col("error").isNull())
    head = F.min_by(F.struct(*heads), F.struct(F.col("range_m").isNull(), "sweep_idx", "ray_idx"))
    own = good.groupBy("site", "scan_key").agg(head.alias("h")).select("site", "scan_key", "h.*")
    return Decoded(good.select(*names), own, rows.where(F.col("error").isNotNull()).select("path", "site", "scan_key", "error"))


def clean_rays(rays: DataFrame) -> DataFrame:
    """RAYS with every masked gate as a null element: NaN would win every maximum."""
    return rays.select(*[F.transform(c, lambda x: F.when(~F.isnan(x), x)).alias(c) if c in FIELDS else F.col(c) for c in rays.columns])


def with_derived_phase(rays: DataFrame, spacing_km: Column, derive: Callable[[Column, Column], Column] = phase.specific_phase, source: str = "differential_phase", target: str = "specific_differential_phase") -> DataFrame:
    """Fills `target` where it is null from `source`; without a source it stays null."""
    if source not in rays.columns:
        return rays
    kind = rays.schema[target].dataType if target in rays.columns else None
    found = derive(F.col(source), spacing_km)
    return rays.withColumn(target, F.coalesce(F.col(target), found.cast(kind)) if kind else found)
