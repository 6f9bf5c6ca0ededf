"""Populated places from files: Parquet, CSV, GeoJSON lines, or point shapefiles (.shp with its .dbf).

Files of a folder are read side by side. A shapefile is a unit, its points and attributes belong together by position, so
a task reads one of them whole (world-wide sets of places have a few megabytes).

Defined cases: a null shape has no place and gives no row, a deleted record neither; a population that isn't a number is
null; a name is trimmed; attribute names are compared in lower case; other shapes than points are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewatch.schemas import PLACES

#: Shape types that begin with a point, and that of a null shape: fixed values of the format.
POINTS, NO_SHAPE = (1, 11, 21), 0


def points(content: bytes) -> list[tuple[float, float] | None]:
    """The records of a .shp file: longitude and latitude, None for null shapes."""
    out, at = [], 100  # behind the file's header
    while at + 12 <= len(content):
        words = struct.unpack_from(">i", content, at + 4)[0]
        kind = struct.unpack_from("<i", content, at + 8)[0]
        if kind not in (*POINTS, NO_SHAPE):
            raise ValueError(f"shapes of type {kind} are no points")
        out.append(None if kind == NO_SHAPE else struct.unpack_from("<2d", content, at + 12))
        at += 8 + 2 * words
    return out


def attributes(content: bytes, wanted: set[str], encoding: str = "utf-8") -> list[dict[str, str] | None]:
    """The records of a .dbf file as text by lower-case name, None for deleted ones."""
    count, start, width = struct.unpack_from("<IHH", content, 4)
    columns, at, offset = [], 32, 1
    while content[at] != 0x0D:
        name = content[at : at + 11].split(b"\0")[0].decode("ascii", "replace").lower()
        if name in wanted:
            columns.append((name, offset, content[at + 16]))
        offset += content[at + 16]
        at += 32
    rows = (content[start + i * width : start + (i + 1) * width] for i in range(count))
    return [None if r[:1] == b"*" else {n: r[a : a + k].decode(encoding, "replace").strip("\0 ") for n, a, k in columns} for r in rows]


def shapefiles(spark: SparkSession, path: str, name: str = "name", population: str = "pop_max") -> DataFrame:
    """A .shp file, or a folder of them with their .dbf files -> PLACES. name, population: the attributes to take."""
    stem = path[:-4] if path.lower().endswith(".shp") else None
    files = spark.read.format("binaryFile").load([f"{stem}.shp", f"{stem}.dbf"] if stem else path)
    own = files.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), F.lower(F.substring_index("path", ".", -1)).alias("kind"), "content")
    both = own.where("kind = 'shp'").select("stem", F.col("content").alias("shp")).join(own.where("kind = 'dbf'").select("stem", F.col("content").alias("dbf")), "stem")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                pairs = zip(points(r.shp), attributes(r.dbf, {name.lower(), population.lower()}))
                rows = [(a.get(name.lower()), *p, a.get(population.lower())) for p, a in pairs if p is not None and a is not None]
                yield pd.DataFrame(rows, columns=["name", "lon", "lat", "pop_max"])

    told = both.select("shp", "dbf").mapInPandas(run, "name string, lon double, lat double, pop_max string")
    return told.withColumn("pop_max", F.col("pop_max").try_cast("double").cast("long"))


def read_places(spark: SparkSession, path: str, name: str = "name", population: str = "pop_max") -> DataFrame:
    """PLACES of a file or folder, by its ending: .shp, .parquet, .csv (with a header) or .json / .geojson (a feature a line)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "shp":
        return shapefiles(spark, path, name, population)
    if kind in ("json", "geojson"):
        features = spark.read.schema("properties map<string,string>, geometry struct<type:string,coordinates:array<double>>").json(path)
        rows = features.where("geometry.type = 'Point'").select(F.col("properties")[name].alias("name"), F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"), F.col("properties")[population].alias("pop_max"))
    else:
        table = spark.read.option("header", "true").csv(path) if kind == "csv" else spark.read.parquet(path)
        rows = table.select(F.col(name).alias("name"), "lon", "lat", F.col(population).alias("pop_max"))
    rows = rows.select(F.trim("name").alias("name"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col("pop_max").cast("string").try_cast("double").cast("long").alias("pop_max"))
    return rows.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(*[c.split()[0] for c in PLACES.split(", ")])
