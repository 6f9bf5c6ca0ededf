"""The latest state of each key as a maintained table: micro-batches or rounds are merged into the parts they touch.

A snapshot is Parquet in a fixed number of parts, dealt by a hash of the key. A merge reads the parts that new rows fall
into, keeps each key's last row by its order, and overwrites just these parts. So what a reader or a merge reads depends
on the number of keys, never on how many batches there were. A merge that is cut off is done again with the same rows:
the last row by order is the same, whichever parts were already replaced.

Defined cases: a null key is a key; rows that tie in their order are equal or one of them stays, by their other columns;
an empty batch changes nothing; a snapshot that isn't there yet is empty. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewatch.functions.tables import path_exists, stored

PARTS = 32


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's row of the greatest `order`."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order, *(c for c in rest if c not in order)))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*").select(*rows.columns)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The snapshot, or an empty table before the first merge."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, _part int").parquet(path).drop("_part")


def merge(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], parts: int = PARTS) -> None:
    """Merges rows into the snapshot at path. Only parts that rows fall into are read and written."""
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    new = stored(latest(rows, keys, order).withColumn("_part", part), "snapshot_batch")
    touched = [r["_part"] for r in new.select("_part").distinct().collect()]  # numbers, at most `parts`
    if not touched:
        return
    if path_exists(spark, path):
        held = spark.read.schema(new.schema).parquet(path).where(F.col("_part").isin(touched))
        new = stored(latest(held.unionByName(new), [*keys, "_part"], order), "snapshot_parts")  # written before its parts are replaced
    new.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)


def maintained(path: str, keys: Sequence[str], order: Sequence[str], parts: int = PARTS, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every micro-batch is merged; one that is repeated changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        merge(shape(batch), path, keys, order, parts)

    return write
