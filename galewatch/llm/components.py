"""Connected components of a graph given as edges, by alternating large and small stars.

Every round is two aggregations and two joins on the edges; hubs are met by partial aggregation and by joins whose hot
side Spark can split. Each round is written to the shared folder, so lineage stays short and lost executors cost one
round at most. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewatch.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)).cast("decimal(28,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """u, v (long) -> node, component: the smallest node that is reachable. Nodes without an edge to another have no row.

    Nulls and loops are left out; repeated edges count once.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "edges")
    before, now = None, _signature(e)
    while before != now:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, now = now, _signature(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes of one task and its edges a-b: the smallest node that each one reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
