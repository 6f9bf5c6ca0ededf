"""Ranked lexical search with an inverted treap per term.

A term's posting list is a treap: a search tree by document order whose parents have impacts no smaller than their
children's. A document's score for a query is the sum of its terms' impacts times the terms' weights, so the impact at a
treap's root, or at the root of its part between two documents, bounds what the term can add there.

1. One pass over the documents stores, for each, its length and its occurrences of the queries' terms. Numbers of
   documents and terms and the terms' document frequencies are aggregates of that table.
2. A task reads its documents in shards of bounded size, sorts a shard by doc_id and builds a treap per term. Impacts
   are put in levels, the heap goes by level and, within a level, by an even split, so that a treap's depth is bounded
   even where impacts rise with doc_id.
3. A query walks its terms' treaps at the same time. A state is a range of documents with the root of every term's part
   in it, and its bound is the weighted sum of these roots' largest impacts. States are taken by bound; one that can't
   enter the best k is dropped with everything below it, others are halved, each treap going down to the root of its
   half, and short ranges are scored. The best k of a query stay from shard to shard, so later shards prune more.
4. The tasks' best k are ranked together: at most k rows a task and query.

Queries go in blocks of bounded size, which is what is broadcast; every block reads all documents.

Terms are runs of ASCII letters, digits and all characters beyond ASCII; A-Z are lower-cased. With N documents that have
terms, L terms in all, df documents with the term, tf occurrences in a document of n terms:
weight = floor(1000 ln((2 N + 2) / (2 df + 1))), times the term's occurrences in the query; m = 25 + (75 n N) div L;
impact = (10^9 tf) div (1000 tf + 8 m).

Defined cases: a null text has no terms; a document or query without terms is in no result, nor is one with score 0;
equal scores go by doc_id, null last; rows that repeat a doc_id are documents of their own; query rows that repeat both
item_id and text are one query, those that repeat item_id only are ranked each by itself; an empty table of documents or
queries gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galewatch.llm.common import running_total, stored, table
from galewatch.llm.wordarrays import byte_texts, chunks

K = 10
#: Terms of a block of queries (the last one may go beyond); documents and postings of a shard, whichever is reached first.
BLOCK_TERMS, SHARD_DOCS, SHARD_POSTINGS = 1 << 18, 1 << 14, 1 << 21
#: Levels of impact; documents of a range that is scored; states that are halved at once.
LEVELS, LEAF, WAVE = 32, 16, 64
#: Bytes that belong to terms, A-Z lower-cased; all others become spaces.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def int_lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for r in rows for x in r], pa.int32()))


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, text -> item_id, query (a hash of both), terms, counts, block: distinct queries with terms, in blocks."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            counted = [Counter(terms_of(t)) for t in byte_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(c) for c in counted], pa.list_(pa.binary())), int_lists([list(c.values()) for c in counted])], ["item_id", "query", "terms", "counts"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows = own.select("item_id", F.xxhash64("item_id", "text").alias("query"), "text").mapInArrow(run, "item_id long, query long, terms array<binary>, counts array<int>")
    order = [F.col("item_id"), F.col("query")]
    rows = rows.where(F.size("terms") > 0).repartitionByRange(*order).select("*", F.spark_partition_id().alias("range"), F.size("terms").alias("n"))
    rows = running_total(stored(rows, "queries"), [], "range", order, "n", "upto")
    return stored(rows.select("item_id", "query", "terms", "counts", F.floor((F.col("upto") - F.col("n")) / BLOCK_TERMS).alias("block")), "query_blocks")


def occurrences(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, text -> doc_id, length, terms (by number), counts: a row per document that has any term."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in source:
            texts = byte_texts(batch.column(1))
            for a, b in chunks(texts):
                kept, lengths, terms, counts = [], [], [], []
                for i in range(a, b):
                    words = terms_of(texts[i])
                    if words:
                        counted = Counter(words)
                        held = [t for t in counted if t in asked]
                        kept.append(i)
                        lengths.append(len(words))
                        terms.append([asked[t] for t in held])
                        counts.append([counted[t] for t in held])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), int_lists(terms), int_lists(counts)], ["doc_id", "length", "terms", "counts"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, length long, terms array<int>, counts array<int>")


class Treaps(NamedTuple):
    """The posting lists of a shard, one after the other. Node 0 is no node."""

    doc: np.ndarray
    left: np.ndarray
    right: np.ndarray
    top: np.ndarray  # the largest impact in the node's subtree
    root: np.ndarray  # by term


def nearest_greater(key: np.ndarray, active: np.ndarray, step: int) -> np.ndarray:
    """For the active places, the nearest place in direction step with a greater key; what is passed over is smaller."""
    at = np.arange(len(key)) + step
    while len(active):
        active = active[key[at[active]] <= key[active]]
        at[active] = at[at[active]]
    return at


def build_treaps(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int) -> Treaps:
    """Postings, sorted by term and doc. Between any two of one key is one of a greater key, so parents are unique."""
    listed, starts, sizes = np.unique(term, return_index=True, return_counts=True)
    which = np.repeat(np.arange(len(listed)), sizes)
    most = np.repeat(np.maximum.reduceat(impact, starts), sizes) if len(term) else impact
    level = impact * LEVELS // (most + 1)
    order = np.lexsort((which * LEVELS + level,))  # stable: by list and level, then by document
    group = (which * LEVELS + level)[order]
    fresh = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    turn = np.arange(len(group)) - np.maximum.accumulate(np.where(fresh, np.arange(len(group)), 0)) + 1
    even = np.empty(len(term), np.int64)
    even[order] = np.log2(turn & -turn).astype(np.int64)
    place = np.arange(len(term)) + which + 1  # a wall stands before each list and after the last
    size = len(term) + len(listed) + 1
    key = np.full(size, np.iinfo(np.int64).max)
    key[place] = level * 64 + even
    before, after = nearest_greater(key, place, -1), nearest_greater(key, place, 1)
    p, n = before[place], after[place]
    root, left, right = np.zeros(n_terms, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    top, own = np.zeros(size, np.int64), np.full(size, -1)
    own[place], top[place] = doc, impact
    wall = np.iinfo(np.int64).max
    is_root = (key[p] == wall) & (key[n] == wall)
    is_right = ~is_root & (key[p] < key[n])
    is_left = ~is_root & ~is_right
    root[term[is_root]] = place[is_root]
    right[p[is_right]] = place[is_right]
    left[n[is_left]] = place[is_left]
    rising = place[np.argsort(key[place], kind="stable")]
    for nodes in np.split(rising, np.flatnonzero(np.diff(key[rising])) + 1):
        top[nodes] = np.maximum(top[nodes], np.maximum(top[left[nodes]], top[right[nodes]]))
    return Treaps(own, left, right, top, root)


class Shard(NamedTuple):
    ids: np.ndarray  # ascending, NO_ID for null
    treaps: Treaps
    starts: np.ndarray  # of each document's postings in the next two
    term: np.ndarray
    impact: np.ndarray

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        total = np.r_[0, np.cumsum(weights[self.term[at]] * self.impact[at])]
        return total[ends] - total[ends - sizes]


def make_shard(ids: np.ndarray, length: np.ndarray, sizes: np.ndarray, term: np.ndarray, count: np.ndarray, n_docs: int, n_words: int, n_terms: int) -> Shard:
    order = np.argsort(ids, kind="stable")
    starts = np.r_[0, np.cumsum(sizes)]
    ids, length, sizes = ids[order], length[order], sizes[order]
    ends = np.cumsum(sizes)
    at = np.arange(len(term)) + np.repeat(starts[:-1][order] - (ends - sizes), sizes)
    term, count = term[at], count[at].astype(np.int64)
    m = 25 + (75 * length * n_docs) // n_words
    impact = (1_000_000_000 * count) // (1000 * count + 8 * np.repeat(m, sizes))
    doc = np.repeat(np.arange(len(ids)), sizes)
    listed = np.lexsort((doc, term))
    return Shard(ids, build_treaps(term[listed], doc[listed], impact[listed], n_terms), np.r_[0, ends], term, impact)


class Best(NamedTuple):
    """A query's best documents so far."""

    score: np.ndarray
    doc_id: np.ndarray

    def floor(self, k: int) -> tuple[int, int]:
        """What a document must reach, and the doc_id that it may have at most where it just does."""
        return (int(self.score[-1]), int(self.doc_id[-1])) if len(self.score) == k else (1, NO_ID)

    def with_more(self, score: np.ndarray, doc_id: np.ndarray, k: int) -> Best:
        score, doc_id = np.r_[self.score, score[score > 0]], np.r_[self.doc_id, doc_id[score > 0]]
        order = np.lexsort((doc_id, -score))[:k]
        return Best(score[order], doc_id[order])


def descended(t: Treaps, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The root of each treap's part between low and high (a row of nodes for each range)."""
    flat, low, high = node.ravel().copy(), np.repeat(low, node.shape[1]), np.repeat(high, node.shape[1])
    active = np.flatnonzero(flat)
    while len(active):
        at = flat[active]
        over, under = t.doc[at] > high[active], t.doc[at] < low[active]
        moved = over | under
        active, at, over = active[moved], at[moved], over[moved]
        flat[active] = np.where(over, t.left[at], t.right[at])
        active = active[flat[active] > 0]
    return flat.reshape(node.shape)


def search(shard: Shard, terms: np.ndarray, own: np.ndarray, weights: np.ndarray, best: Best, k: int) -> Best:
    """The best k of `best` and the shard's documents. weights: by term, those of the query; own: of its terms."""
    t = shard.treaps
    some = t.root[terms] > 0
    node, own = t.root[terms[some]][None, :], own[some]
    low, high = np.zeros(1, np.int64), np.full(1, len(shard.ids) - 1)
    bound = t.top[node] @ own
    while True:
        floor, last = best.floor(k)
        keep = np.flatnonzero((bound > floor) | ((bound == floor) & (shard.ids[low] <= last)))
        if not len(keep):
            return best
        keep = keep[np.argsort(-bound[keep], kind="stable")]
        low, high, node, bound = low[keep], high[keep], node[keep], bound[keep]
        # The leading states only: they raise the floor for the others.
        now = np.arange(len(low)) < WAVE
        short = now & (high - low < LEAF)
        split = now & ~short
        if short.any():
            sizes = high[short] - low[short] + 1
            docs = np.repeat(low[short] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            best = best.with_more(shard.scores(docs, weights), shard.ids[docs], k)
        middle = (low[split] + high[split]) // 2
        a, b = np.r_[low[split], middle + 1], np.r_[middle, high[split]]
        halves = descended(t, np.concatenate([node[split], node[split]]), a, b)
        low, high, node, bound = np.r_[low[~now], a], np.r_[high[~now], b], np.concatenate([node[~now], halves]), np.r_[bound[~now], t.top[halves] @ own]


def searched(n_docs: int, n_words: int, n_terms: int, sent, k: int):
    """Documents of `occurrences` -> number of the query, doc_id, score: the best k of the task's documents."""

    def shards(source: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        parts, docs, postings = [], 0, 0
        for batch in source:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(sizes)
            start = 0
            while start < len(sizes):
                room = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SHARD_POSTINGS - postings, "right")) - start
                take = min(max(room, 0 if docs else 1), SHARD_DOCS - docs, len(sizes) - start)
                if take:
                    part = batch.slice(start, take)
                    parts.append((part.column(0).fill_null(NO_ID).to_numpy(), part.column(1).to_numpy(), sizes[start : start + take], part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()))
                    docs, postings, start = docs + take, postings + int(sizes[start : start + take].sum()), start + take
                if start < len(sizes):
                    yield make_shard(*map(np.concatenate, zip(*parts)), n_docs, n_words, n_terms)
                    parts, docs, postings = [], 0, 0
        if docs:
            yield make_shard(*map(np.concatenate, zip(*parts)), n_docs, n_words, n_terms)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, none = sent.value, np.zeros(0, np.int64)
        best = [Best(none, none)] * len(queries)
        weights = np.zeros(n_terms, np.int64)
        for shard in shards(source):
            for i, (terms, own) in enumerate(queries):
                weights[terms] = own
                best[i] = search(shard, terms, own, weights, best[i], k)
                weights[terms] = 0
        sizes = [len(b.score) for b in best]
        ids = np.concatenate([none, *(b.doc_id for b in best)])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), sizes), pa.int32()), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([none, *(b.score for b in best)]))], ["number", "doc_id", "score"])

    return run


def search_block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """Rows of one block of query_terms -> number, doc_id, score."""
    numbers: dict[bytes, int] = {}
    for r in rows:
        for t in r["terms"]:
            numbers.setdefault(bytes(t), len(numbers))
    held = stored(occurrences(docs, numbers), "occurrences")
    n_docs, n_words = held.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    # A number for each of the block's terms.
    found = dict(held.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(i, 0) + 1))) for i in range(len(numbers))], np.int64)
    queries = []
    for r in rows:
        terms = np.array([numbers[bytes(t)] for t in r["terms"]], np.int64)
        queries.append((terms, weight[terms] * np.array(r["counts"], np.int64)))
    sent = docs.sparkSession.sparkContext.broadcast(queries)
    return held.mapInArrow(searched(n_docs, n_words, len(numbers), sent, k), "number int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text and item_id, text -> item_id, query, rank, doc_id, score: each query's best k documents."""
    spark = docs.sparkSession
    queries = query_terms(items)
    out = None
    for block in range((queries.agg(F.max("block")).first()[0] or 0) + 1):
        rows = queries.where(F.col("block") == block).orderBy("item_id", "query").collect()
        found = search_block(docs, rows, k)
        names = spark.createDataFrame([(i, r["item_id"], r["query"]) for i, r in enumerate(rows)], "number int, item_id long, query long")
        order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = stored(best.join(names, "number").select("item_id", "query", "rank", "doc_id", "score"), "ranked")
        out = out.unionAll(best) if out else best
    return out


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
len AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
tot AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM len),
m AS (SELECT doc_id, 25 + (75 * n * n_docs) // n_words AS m FROM len, tot),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) q
  GROUP BY item_id, term),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, tot),
s AS (
  SELECT item_id, tf.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN w ON asked.term = w.term JOIN tf ON tf.term = w.term JOIN m ON m.doc_id = tf.doc_id GROUP BY item_id, tf.doc_id),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
