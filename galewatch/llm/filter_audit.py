"""Audit of how five document filters interact, by inclusion-exclusion.

For every set T of filters, J(T) counts the documents that fail all filters of T: a sum of products of failure flags,
so one aggregation with partial sums gives all 32 of them. What filters in any order do follows from J alone:

* Moebius inversion: kept(S) = sum of (-1)^|T| J(T) over T within S are the documents that pass all of S.
* A filter i after those of P removes kept(P) - kept(P with i); J({i}) minus that was redundant, being removed before.
* Failing i only: kept(all but i) - kept(all).
* With v(S) = J({}) - kept(S), the documents S removes, the Harsanyi dividend of T is (-1)^(|T|+1) J(T); a filter's
  Shapley value is the sum of dividend(T) / |T| over T that hold it, and 120 times that is its sum over all orders.

The same sums weighted by a label give what is lost of good and of toxic documents.

A copy of an earlier text is told without a join on texts: only the rows at a text's smallest doc_id aren't copies, and
these are found by (digest, doc_id), which no group of copies makes hot.

Defined cases: a null text is an empty one; a null source is the part ''; a row without doc_id is never a copy, names no
text's first document and has no labels; rows that repeat doc_id and text are documents of their own and no copies of
each other; of several label rows of one document any 1 counts; an empty table has no parts and gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewatch.llm.common import SPACE, stored, table, text_of

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column, words: Column) -> list[Column]:
    """Failure of A to D, which a text has by itself; words is the array of the text's words."""
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask -> with n: bit i of mask says that filter i of A to D fails; n rows repeat it."""
    parts = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), parts, text_of().alias("text"))
    split = read.select("doc_id", "part", "text", F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(text_failures(F.col("text"), F.col("words")))), F.lit(0))
    rows = split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    return rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))


def with_copies(rows: DataFrame) -> DataFrame:
    """Rows of `flagged` with the bit of E: a smaller doc_id has the text."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull()).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + copy).drop("first")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic (0 or 1). Rows without doc_id are dealt by their text, so that they aren't one key."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where(F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic")).withColumn("deal", F.lit(0).cast("long"))
    dealt = rows.withColumn("deal", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    return dealt.join(known, ["doc_id", "deal"], "left").select("part", "mask", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def joint_failures(rows: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic -> part, and J of all sets as arrays: every, good, toxic."""
    product = lambda t: F.when(F.col("mask").bitwiseAND(F.lit(t)) == t, F.col("n")).otherwise(0)
    # Rows of one part, mask and label are summed first: the 96 sums then see 128 rows a part and task at most.
    few = rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    weights = {"every": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    return few.groupBy("part").agg(*[F.array(*[F.sum(product(t) * w) for t in SETS]).alias(k) for k, w in weights.items()])


def survivors(joint: Column) -> Column:
    """J -> kept, both arrays over all sets: the Moebius inversion over subsets."""
    sign = lambda t: -1 if t.bit_count() % 2 else 1
    return F.array(*[sum((joint[t] * sign(t) for t in SETS if t & s == t), F.lit(0).cast("long")) for s in SETS])


def shapley(joint: Column, orders: int) -> Column:
    """J -> an array over the filters: Shapley values times the number of orders."""
    share = lambda t: (1 if t.bit_count() % 2 else -1) * (orders // t.bit_count())
    return F.array(*[sum((joint[t] * share(t) for t in SETS if t >> i & 1), F.lit(0).cast("long")) for i in range(len(FILTERS))])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    joint = stored(joint_failures(with_labels(with_copies(stored(flagged(docs), "flags")), labels)), "joint_failures")
    told = joint.select("part", "every", *[survivors(F.col(k)).alias(f"kept_{k}") for k in ("every", "good", "toxic")], shapley(F.col("every"), len(orders)).alias("values"))
    rows = told.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    which = F.ascii(F.substr("filter_order", F.col("step"), F.lit(1))) - ord(FILTERS[0])
    applied = F.split(F.substr("filter_order", F.lit(1), F.col("step") - 1), "")
    before = F.aggregate(F.filter(applied, lambda x: x != ""), F.lit(0), lambda m, x: m + F.call_function("shiftleft", F.lit(1), F.ascii(x) - ord(FILTERS[0])))
    rows = rows.withColumn("which", which).withColumn("before", before).withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("which")))
    at = lambda k, s: F.get(F.col(k), s)
    lost = lambda k: at(k, F.col("before")) - at(k, F.col("before") + F.col("bit"))
    return rows.select(
        "part", "filter_order", "step", at("kept_every", F.col("before") + F.col("bit")).alias("kept"), lost("kept_every").alias("removed"),
        (at("every", F.col("bit")) - lost("kept_every")).alias("redundant"), (at("kept_every", F.lit(31) - F.col("bit")) - at("kept_every", F.lit(31))).alias("unique_fails"),
        lost("kept_good").alias("good_lost"), lost("kept_toxic").alias("toxic_lost"), at("values", F.col("which")).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Orders are walked document class by document class, without inclusion-exclusion.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
marked AS (
  SELECT d.doc_id, part,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN d.doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN firsts ON d.text = firsts.text),
tags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
classes AS (
  SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM marked LEFT JOIN tags ON marked.doc_id = tags.doc_id GROUP BY 1, 2, 3, 4),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l),
steps AS (SELECT filter_order, s.step, substr(filter_order, s.step, 1) AS own, substr(filter_order, 1, s.step - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
walked AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails = own AS alone, contains(fails, own) AS failing,
         earlier <> '' AND regexp_matches(fails, '[' || earlier || '-]') AS gone
  FROM classes, steps),
told AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND failing THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM walked GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM told
"""
