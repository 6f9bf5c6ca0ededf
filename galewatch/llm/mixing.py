"""Mixing sources to target weights by weighted fair queueing (built-in functions only).

Every copy of a document gets a virtual finish time: its source's running size in shuffled order, divided by the
source's target. Copies are sorted globally by that time, in range partitions, and taken until the budget is used up:
sums by partition and running sums inside each one give every copy's total. So every source advances evenly towards its
target, and no task holds more than a partition of the sort or a bucket of a source's order.

Shuffled order is that of a hash of doc_id and text. Rows that repeat both are one row with a count until their place is
known, so neither rows without doc_id nor many equal rows make one task large.

Defined cases: a null text has size 0 and is never taken; a source without words has the target 0; a null source is a
source of its own, last in order; repeated rows are documents of their own; equal finish times go by source order, and
within a source by shuffled position; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewatch.llm.common import n_words, running_total, stored, table, text_of

EPOCHS = 3
WEIGHTS = (5, 2, 1)
#: Rows of a bucket of a source's shuffled order, on average; sources up to which one task ranks them.
BUCKET_ROWS, FEW_SOURCES = 20_000, 10_000


def ordered(df: DataFrame, *order: Column, few: bool = False) -> DataFrame:
    """df, stored in range partitions of the given order, with their number as `range`; for running_total. few: one
    range holds all, and nothing has to move."""
    if few:
        return df.withColumn("range", F.lit(0))
    return stored(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix_ranges")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> ord, source, source_size, target, budget.

    Weights repeat over the sources in code-point order, null last. The budget is the size of all sources. A target
    stops at `epochs` times its source's size and what is above is shared by weight among the others: the level at
    which that ends is found from running sums over the sources in the order in which they reach their stop. Sources
    may be as many as hosts of a crawl: beyond FEW_SOURCES, ranks and running sums are taken by range partition.
    """
    few = sizes.count() <= FEW_SOURCES
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = running_total(ordered(sizes.select("source", "source_size", F.lit(1).alias("one")), *by_name, few=few), [], "range", by_name, "one", "ord").withColumn("ord", F.col("ord") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ord") % len(weights) + 1).cast("int"))
    most = F.col("source_size") * float(epochs)
    ranked = ranked.select("source", "source_size", "ord", weight.alias("weight")).withColumn("most", most).withColumn("stop", F.col("most") / F.col("weight"))
    by_stop = [F.col("stop"), F.col("ord")]
    ranked = ordered(stored(ranked, "mix_stops"), *by_stop, few=few)
    budget, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    for value in ("most", "weight"):
        ranked = running_total(ranked, [], "range", by_stop, value, f"{value}_upto")
    # Sums of sizes and weights are whole numbers, so doubles hold them exactly and the order of addition is free.
    level = (F.lit(float(budget or 0)) - (F.col("most_upto") - F.col("most"))) / (F.lit(weight or 0.0) - (F.col("weight_upto") - F.col("weight")))
    reached = F.when(level <= F.col("stop"), F.struct("stop", "ord"))
    level = ranked.agg(F.min_by(level, reached)).first()[0] or 0.0
    return ranked.select("ord", "source", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target"), F.lit(budget or 0).cast("long").alias("budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """doc_id, text, source -> doc_id, source, size, source_size, target, epochs_taken, taken, finish, text_hash.

    taken = epochs_taken * size: whole copies only, so the mix ends within one document of the budget.
    finish is the virtual finish time of the first copy: ordering by it gives the mix in its order.
    """
    sized = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(text_of()).alias("size"), F.xxhash64(text_of()).alias("text_hash"), F.md5(text_of()).alias("text_name"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_name")))
    same = ["doc_id", "source", "size", "text_hash", "key"]
    base = stored(sized.withColumn("key", key).groupBy(*same).agg(F.count("*").alias("n")), "mix_sizes")
    buckets = max(32, base.count() // BUCKET_ROWS)
    sources = stored(base.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "mix_sources")
    plan = stored(targets(sources, weights, epochs), "mix_targets")
    share = F.conv(F.substring("key", 1, 7), 16, 10).cast("double") / float(16**7)
    rows = base.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", F.floor(share * buckets).cast("int")).withColumn("words", F.col("size") * F.col("n"))
    rows = running_total(rows, ["ord"], "bucket", [F.col("key"), F.col("doc_id"), F.col("size"), F.col("text_hash")], "words", "upto")
    # Equal rows follow one another; which of them is which is all the same.
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("cum", F.col("upto") - F.col("size") * (F.col("n") - F.col("turn")))
    rows = stored(rows.drop("bucket", "words", "upto", "turn", "n"), "mix_order")
    # In a source, equal positions differ at most in empty documents, which take nothing either way.
    # A source without words has the target 0 and no finish times.
    finish = lambda e: F.try_divide((e * F.col("source_size") + F.col("cum")).cast("double"), F.col("target"))
    usable = (F.col("size") > 0) & (F.col("target") > 0)
    copies = rows.where(usable).select("ord", "size", F.explode(F.array(*[finish(F.lit(e)) for e in range(epochs)])).alias("finish"))
    # The global sort. What it gives is the place of the last copy taken; each document then counts its own copies up to it.
    order = [F.col("finish"), F.col("ord")]
    budget = plan.agg(F.max("budget")).first()[0] or 0
    totals = running_total(ordered(copies, *order), [], "range", order, "size", "total")
    last = totals.where(F.col("total") <= budget).agg(F.max(F.struct("finish", "ord")).alias("last")).first()["last"]
    stop = F.struct(F.lit(last["finish"] if last else -1.0).alias("finish"), F.lit(last["ord"] if last else 0).cast("long").alias("ord"))
    taken = lambda f: F.struct(f.alias("finish"), F.col("ord").cast("long").alias("ord")) <= stop
    times = sum((F.when(usable & taken(finish(F.lit(e))), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", times.cast("int").alias("epochs_taken"), (times * F.col("size")).cast("long").alias("taken"), finish(F.lit(0)).alias("finish"), "text_hash")


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it; a row stands for all rows that repeat it."""
    mixed = mix(docs, weights, epochs, seed).where(F.col("epochs_taken") > 0)
    times = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash")).agg(F.sum("epochs_taken").cast("int").alias("_times"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_a"), F.col("source").cast("string").alias("_b"), F.xxhash64(text_of()).alias("_c"))
    same = F.col("_a").eqNullSafe(F.col("_id")) & F.col("_b").eqNullSafe(F.col("_source")) & (F.col("_c") == F.col("_hash"))
    joined = rows.join(times, same).dropDuplicates(["_a", "_b", "_c"])
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("_row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "finish")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS ord FROM s),
w AS (SELECT *, CASE ord % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r),
t AS (SELECT *, source_size * 3.0::DOUBLE / weight AS stop FROM w),
l AS (SELECT *, sum(source_size) OVER () AS budget,
        (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY stop, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY stop, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level FROM t),
f AS (SELECT level AS lam FROM l WHERE level <= stop ORDER BY stop, ord LIMIT 1),
g AS (SELECT ord, source, source_size, budget, least(source_size * 3.0::DOUBLE, weight * coalesce((SELECT lam FROM f), 0.0::DOUBLE)) AS target FROM l),
c AS (SELECT b.*, g.ord, g.source_size, g.budget, g.target, sum(size) OVER (PARTITION BY g.ord ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
      FROM base b JOIN g ON b.source IS NOT DISTINCT FROM g.source),
e AS (SELECT c.*, k.k, CAST(k.k * source_size + cum AS DOUBLE) / target AS finish FROM c, (VALUES (0), (1), (2)) k(k) WHERE size > 0 AND target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, ord ROWS UNBOUNDED PRECEDING) AS total FROM e),
n AS (SELECT doc_id, key, count(*) AS times FROM o WHERE total <= budget GROUP BY doc_id, key)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(coalesce(n.times, 0) * c.size AS BIGINT) AS taken,
  CASE WHEN c.target > 0 THEN CAST(c.cum AS DOUBLE) / c.target END AS finish
FROM c LEFT JOIN n ON c.doc_id IS NOT DISTINCT FROM n.doc_id
"""
