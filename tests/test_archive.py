"""The archive as a data source: written, read with filters, and as a stream."""

from datetime import date, datetime

import pytest
from conftest import SMALL, same
from pyspark.sql import functions as F

from galewatch.plans import archive_queries
from galewatch.plans.catalog import ORACLES
from galewatch.sources import archive, volumes


@pytest.fixture
def root(spark, tmp_path):
    archive.register(spark)
    rows = [(s, date(2024, m, d), f"{s}2024{m:02}{d:02}_{h:02}0000_V06", f"{s}{m}{d}{h}".encode()) for s in ("KAAA", "KBBB") for m, d in ((1, 31), (2, 1), (2, 3)) for h in (3, 12)]
    rows.append(("KAAA", date(2024, 2, 1), "KAAA20240201_120000_V06_MDM", None))
    spark.createDataFrame(rows, "site string, scan_date date, filename string, content binary").write.format(archive.NAME).option("path", str(tmp_path)).mode("append").save()
    return str(tmp_path)


def load(spark, root, **options):
    return spark.read.format(archive.NAME).option("path", root).options(**options).load()


def test_reads_what_was_written(spark, root):
    rows = load(spark, root).orderBy("site", "scan_date", "ord").collect()
    assert len(rows) == 13 and [r["ord"] for r in rows[:5]] == [0, 1, 0, 1, 2]
    assert rows[0]["content"] == b"KAAA1313" and rows[0]["key"] == f"{root}/2024/01/31/KAAA/KAAA20240131_030000_V06"
    assert load(spark, root, contents="false").where("content is not null").count() == 0
    assert load(spark, root + "/none").count() == 0
    assert load(spark, "file:" + root).count() == load(spark, "file://" + root).count() == 13


def test_filters_reach_the_listing(spark, root, tmp_path):
    (tmp_path / "2024/02/03/KCCC").mkdir(parents=True)
    (tmp_path / "2024/02/03/KCCC").chmod(0)
    asked = archive.ArchiveReader({"path": root})
    left = list(asked.pushFilters([archive.EqualTo(("site",), "KBBB"), archive.GreaterThan(("scan_date",), date(2024, 1, 31)), archive.LessThanOrEqual(("scan_date",), date(2024, 2, 3)), archive.EqualTo(("ord",), 1)]))
    assert len(left) == 1 and asked.partitions() == [archive.SiteDay("KBBB", date(2024, 2, d)) for d in (1, 2, 3)]
    seen = []
    asked.folders.listed = lambda *parts, whole=asked.folders.listed: seen.append(parts) or whole(*parts)
    assert len([r for p in asked.partitions() for r in asked.read(p)]) == 4
    assert seen == [(f"2024/02/{d:02}", "KBBB") for d in (1, 2, 3)]  # no other folder
    found = load(spark, root).where("site = 'KBBB' and scan_date > '2024-01-31' and ord = 1")
    assert found.count() == 2 and found.rdd.getNumPartitions() == 2  # days with folders between the bounds
    assert load(spark, root).where("site in ('KAAA', 'KXXX') and scan_date = '2024-02-01'").count() == 3
    assert load(spark, root).where("site = 'KAAA' and site = 'KBBB'").count() == 0 == load(spark, root).where("scan_date < '2024-01-31'").count()
    assert volumes.archived(spark, root, "kaaa", date(2024, 2, 1), date(2024, 2, 2)).select(F.col("content").cast("string")).orderBy("path").collect() == [("KAAA213",), ("KAAA2112",)]


def test_stream_takes_each_volume_once(spark, root, tmp_path):
    state, out = str(tmp_path / "_state"), str(tmp_path / "_out")

    def step():
        stream = spark.readStream.format(archive.NAME).option("path", root).option("start", "2024-02-01").load()
        stream.select("filename").writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["filename"] for r in spark.read.schema("filename string").parquet(out).collect())

    assert len(first := step()) == 9 and step() == first
    more = [("KAAA", date(2024, 2, 3), "KAAA20240203_130000_V06", b"x"), ("KAAA", date(2024, 2, 4), "KAAA20240204_000000_V06", b"x"), ("KCCC", date(2024, 2, 4), "KCCC20240204_000000_V06", b"x"), ("KBBB", date(2024, 2, 3), "KBBB20240203_000000_V06", b"late")]
    spark.createDataFrame(more, "site string, scan_date date, filename string, content binary").write.format(archive.NAME).option("path", root).mode("append").save()
    assert sorted(set(step()) - set(first)) == sorted(x[2] for x in more[:3]) and len(step()) == 12


def test_query_equals_sql(spark):
    assert same(spark, SMALL, archive_queries.archive_gates, ORACLES["archive_gates"]) > 10
    assert same(spark, SMALL, archive_queries.archive_stream, ORACLES["archive_stream"]) > 10
