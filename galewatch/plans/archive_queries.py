"""Queries over an archive of volumes, written and read by its data source. Line items are the gates; their months are the days."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewatch.functions.tables import shared_dir
from galewatch.plans.radar_queries import query
from galewatch.plans.views import read
from galewatch.sources import archive


def volume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume per site, month and half: its gates as JSON."""
    li = read(spark, sf_dir, "lineitem").select(
        F.element_at(F.array(*map(F.lit, ("KAAA", "KBBB", "KCCC", "KDDD"))), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("site"),
        F.trunc("l_shipdate", "month").cast("date").alias("scan_date"), (F.col("l_linenumber") % 2).alias("half"), F.struct(F.col("l_orderkey").alias("ray"), F.col("l_quantity").cast("int").alias("dbz")).alias("gate"),
    )
    named = li.groupBy("site", "scan_date", "half").agg(F.to_json(F.array_sort(F.collect_list("gate"))).cast("binary").alias("content"))
    return named.select("site", "scan_date", F.concat("site", F.date_format("scan_date", "yyyyMMdd"), F.format_string("_%02d0000_V06", F.col("half") * 12)).alias("filename"), "content")


def written(spark: SparkSession, rows: DataFrame, root: str) -> None:
    archive.register(spark)
    rows.write.format(archive.NAME).option("path", root).mode("append").save()


def gates(files: DataFrame) -> DataFrame:
    """filename, content -> a row per volume."""
    told = F.from_json(F.col("content").cast("string"), "array<struct<ray:long,dbz:int>>")
    return files.select("site", "filename", told.alias("g")).select("site", "filename", F.size("g").alias("gates"), F.array_max("g.dbz").alias("dbz_max"), F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x["ray"]).alias("rays"))


GATES = """WITH v AS (SELECT CASE l_suppkey % 4 WHEN 0 THEN 'KAAA' WHEN 1 THEN 'KBBB' WHEN 2 THEN 'KCCC' ELSE 'KDDD' END AS site, date_trunc('month', l_shipdate) AS day, l_linenumber % 2 AS half, l_orderkey AS ray, CAST(l_quantity AS INTEGER) AS dbz FROM lineitem),
f AS (SELECT site, CAST(day AS DATE) AS day, site || strftime(day, '%Y%m%d') || CASE half WHEN 0 THEN '_000000_V06' ELSE '_120000_V06' END AS filename, CAST(count(*) AS INTEGER) AS gates, max(dbz) AS dbz_max, CAST(sum(ray) AS BIGINT) AS rays FROM v GROUP BY site, day, half)
SELECT site, filename, gates, dbz_max, rays FROM f"""


@query(f"{GATES} WHERE site IN ('KBBB', 'KDDD') AND day >= DATE '1993-01-01' AND day < DATE '1997-01-01'")
def archive_gates(spark, sf_dir):
    """Volumes of two sites and four years out of the archive; only their folders are listed."""
    written(spark, volume_rows(spark, sf_dir), root := f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}")
    files = spark.read.format(archive.NAME).option("path", root).load()
    return gates(files.where(F.col("site").isin("KBBB", "KDDD") & (F.col("scan_date") >= "1993-01-01") & (F.col("scan_date") < "1997-01-01")))


@query(f"{GATES} WHERE day >= DATE '1994-01-01'")
def archive_stream(spark, sf_dir):
    """All volumes from a day on, taken by a stream that ends and goes on while the archive grows."""
    rows, root = volume_rows(spark, sf_dir), f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    for part in (rows.where("scan_date < '1996-01-01'"), rows.where("scan_date >= '1996-01-01'")):
        written(spark, part, f"{root}/in")
        stream = spark.readStream.format(archive.NAME).option("path", f"{root}/in").option("start", "1994-01-01").load()
        gates(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")
