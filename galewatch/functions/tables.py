"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where the setting is missing, a temporary folder stands in on one machine; elsewhere that is an error, since each
    executor would write to a disk of its own. Nothing here removes the tables: who sets the folder clears it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = shared_dir.own = tempfile.mkdtemp(prefix="spark-")
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: computed once, short lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/galewatch-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _opened(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _opened(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, sorted; none where there is no folder."""
    fs, p = _opened(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _opened(spark, path)
    fs.delete(p, True)
