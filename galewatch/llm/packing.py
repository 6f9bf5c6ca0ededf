"""Packing with optimal length buckets.

A document longer than MAX_LENGTH is cut into pieces, all kept. The global histogram of piece lengths has at most
MAX_LENGTH rows, whatever the corpus; dynamic programming over it finds the bucket boundaries that minimise padding.
Inside each bucket the pieces, in shuffled order, form batches of a fixed token budget.

Defined cases: a document without words has one piece of length 0, which belongs to no batch (nulls); repeated rows are
packed each for itself; a null doc_id is kept; ties in the order go by doc_id and piece; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewatch.llm.common import n_words, running_total, stored, table, text_of

MAX_LENGTH, BUCKETS, BATCH_TOKENS = 2048, 8, 16384


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Bucket lengths with the least padding in all; among equals, the smallest boundaries from the longest down."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[x] for x in lengths], dtype=np.int64)
    n, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    m = len(lengths)
    # best[j]: least padding of the j shortest lengths in the buckets so far; a bucket (i, j] pads to lengths[j - 1].
    best = np.r_[0, np.full(m, np.iinfo(np.int64).max // 4)]
    back = []
    for _ in range(min(buckets, m)):
        new, came = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], came[j] = cost[i], i
        best = new
        back.append(came)
    out, j = [], m
    for came in reversed(back):
        if j and came[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(came[j])
    return out[::-1]


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, length=None) -> DataFrame:
    """doc_id, text -> doc_id, piece, length, bucket_length, batch, slot, padding.

    `length`: a column with a document's tokens; its words where not given. Piece p holds the tokens from
    p * max_length on. A batch is one of its bucket's; slot is the place in it.
    """
    size = n_words(text_of()) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    base = docs.select(F.col("doc_id"), size.alias("tokens"))
    last = F.greatest(F.floor((F.col("tokens") - 1) / max_length), F.lit(0)).cast("int")
    pieces = base.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.col("tokens") - F.col("piece") * max_length, F.lit(max_length)).cast("long").alias("length"))
    pieces = stored(pieces, "pieces")
    ends = boundaries({r["length"]: r["count"] for r in pieces.where(F.col("length") > 0).groupBy("length").count().collect()}, buckets)
    none = pieces.where(F.col("length") == 0).select("doc_id", "piece", "length", *[F.lit(None).cast("long").alias(c) for c in ("bucket_length", "batch", "slot", "padding")])
    if not ends:
        return none
    slots = max(16, pieces.count() // 20_000)
    fit = F.get(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e >= F.col("length")), F.lit(0))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string")))
    share = F.conv(F.substring("key", 1, 7), 16, 10).cast("double") / float(16**7)
    rows = pieces.where(F.col("length") > 0).withColumn("bucket_length", fit).withColumn("key", key).withColumn("part", F.floor(share * slots).cast("int")).withColumn("one", F.lit(1).cast("long"))
    rows = running_total(rows, ["bucket_length"], "part", [F.col("key"), F.col("doc_id"), F.col("piece"), F.col("length")], "one", "place")
    capacity = F.greatest(F.floor(F.lit(batch_tokens) / F.col("bucket_length")), F.lit(1)).cast("long")
    place = F.col("place") - 1
    packed = rows.select("doc_id", "piece", "length", "bucket_length", F.floor(place / capacity).cast("long").alias("batch"), (place % capacity).alias("slot"), (F.col("bucket_length") - F.col("length")).alias("padding"))
    return packed.unionByName(none)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The dynamic programme unrolled, a step per bucket."""
    head = rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS tokens FROM documents),
pieces AS (
  SELECT doc_id, CAST(piece AS INTEGER) AS piece, CAST(least(tokens - piece * {MAX_LENGTH}, {MAX_LENGTH}) AS BIGINT) AS length
  FROM (SELECT doc_id, tokens, unnest(range(0, greatest((tokens - 1) // {MAX_LENGTH}, 0) + 1)) AS piece FROM base)),
h AS (SELECT length, count(*) AS c FROM pieces WHERE length > 0 GROUP BY length),
s AS (SELECT row_number() OVER (ORDER BY length) AS j, length, sum(c) OVER (ORDER BY length) AS n, sum(c * length) OVER (ORDER BY length) AS t FROM h
      UNION ALL SELECT 0, 0, 0, 0),
d0 AS (SELECT j, CASE j WHEN 0 THEN 0 END AS best, CAST(NULL AS BIGINT) AS came FROM s)"""
    steps = "".join(
        f""",
e{k} AS (SELECT b.j, min(a.best + b.length * (b.n - x.n) - (b.t - x.t)) AS best, arg_min(a.j, (a.best + b.length * (b.n - x.n) - (b.t - x.t)) * 1000000 + a.j) AS came
      FROM s b JOIN d{k - 1} a ON a.j < b.j AND a.best IS NOT NULL JOIN s x ON x.j = a.j GROUP BY b.j),
d{k} AS (SELECT d.j, CASE WHEN d.best IS NULL OR e.best < d.best THEN e.best ELSE d.best END AS best, CASE WHEN d.best IS NULL OR e.best < d.best THEN e.came END AS came
      FROM d{k - 1} d LEFT JOIN e{k} e ON d.j = e.j)"""
        for k in range(1, BUCKETS + 1)
    )
    walk = f",\nw{BUCKETS} AS (SELECT max(j) AS j FROM s)" + "".join(f",\nw{k - 1} AS (SELECT CASE WHEN w.j > 0 AND d.came IS NOT NULL THEN d.came ELSE w.j END AS j FROM w{k} w JOIN d{k} d ON d.j = w.j)" for k in range(BUCKETS, 0, -1))
    ends = ",\nends AS (SELECT DISTINCT s.length FROM s JOIN (" + " UNION ALL ".join(f"SELECT j FROM w{k}" for k in range(1, BUCKETS + 1)) + ") w ON w.j = s.j WHERE s.j > 0)"
    tail = f""",
f AS (SELECT p.doc_id, p.piece, p.length, min(e.length) AS bucket_length FROM (SELECT *, row_number() OVER () AS rid FROM pieces) p LEFT JOIN ends e ON e.length >= p.length AND p.length > 0 GROUP BY p.rid, p.doc_id, p.piece, p.length),
g AS (SELECT *, row_number() OVER (PARTITION BY bucket_length ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(piece AS VARCHAR)), doc_id, piece, length) - 1 AS place,
        greatest({BATCH_TOKENS} // bucket_length, 1) AS capacity FROM f)
SELECT doc_id, piece, length, CAST(bucket_length AS BIGINT) AS bucket_length,
       CAST(CASE WHEN bucket_length IS NOT NULL THEN place // capacity END AS BIGINT) AS batch,
       CAST(CASE WHEN bucket_length IS NOT NULL THEN place % capacity END AS BIGINT) AS slot, CAST(bucket_length - length AS BIGINT) AS padding
FROM g
"""
    return head + steps + walk + ends + tail


ORACLE = _oracle()
