"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Only vectors with equal labels are compared. Equal vectors of a label are one class. The classes of a label are dealt
to shards of about SHARD, each shard gets a graph, and every pair of shards of a label is searched: the classes of one
in the graph of the other. An audit scans blocks of AUDITED queries of each pair of shards until it has seen SEEN links
(a query's hit on itself is none); while the graph finds less than RECALL of them, beams are widened, at last to a scan.
Where all queries together have fewer links, the audit was a scan of all, and its links are the result. `audits` tells
what the audits saw. Cosines are verified in double precision, links are counted by class, and components are found over
the spanning forests of all pairs of shards.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component, or that has no label, links
with nothing and is its own component; vectors of other lengths are not compared; a null vec_id takes part, but names a
component only where no other does; repeated rows are equal vectors; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewatch.llm.common import stored, table
from galewatch.llm.components import components, local_labels
from galewatch.llm.hnsw import BEAM, Graph

THRESHOLD = 0.93
SHARD = 8192
AUDITED, SEEN, RECALL = 256, 100, 0.99
GRAPHS = "label string, size int, shard int, graph binary, classes binary, copies binary, exact binary"
LINKS = "class long, component long, links long, asked long, links_seen long, links_found long, beam long"


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The graph of one shard: class, copies, embedding -> a row of GRAPHS."""
    rows = rows.sort_values("class", ignore_index=True)
    exact = np.array(rows["embedding"].tolist(), dtype=np.float64)
    exact /= np.abs(exact).max(axis=1, keepdims=True)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    draw = ((rows["class"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    graph, order = Graph.built(exact.astype(np.float32), draw)
    held = [x.to_numpy(np.int64)[order].tobytes() for x in (rows["class"], rows["copies"])]
    return pd.DataFrame([[rows["label"][0], rows["size"][0], rows["shard"][0], graph.to_bytes(), *held, exact[order].tobytes()]], columns=[c.split()[0] for c in GRAPHS.split(", ")])


def audited(queries: np.ndarray, exact: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries scanned until SEEN links have been met, and all (query, node) pairs they have, self hits included."""
    drawn = np.random.default_rng(0).permutation(len(queries))
    pairs, links, at = [], 0, 0
    while at < len(drawn) and links < SEEN:
        block = drawn[at : at + AUDITED]
        r, b = np.nonzero(queries[block] @ exact.T >= threshold)
        pairs.append((block[r], b))
        links += np.sum(block[r] != b) if queries is exact else len(b)
        at += len(block)
    return drawn[:at], np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def pairs_within(graph: Graph, queries: np.ndarray, exact: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int, int]]:
    """(query, node) pairs with a cosine of at least `threshold`, beams widened until the audit passes, and what it saw:
    queries asked, links of theirs by a scan, how many of them the graph finds, the last beam (0: all were scanned).

    A shard searched in itself is given as the same array twice.
    """
    loose = threshold - 1e-4  # single precision proposes, double decides
    width = BEAM
    q = queries.astype(np.float32)
    audit = (0, 0, 0, 0)
    if 4 * width < len(exact):
        asked, a, b = audited(queries, exact, threshold)
        if len(asked) == len(queries):
            return a, b, (len(asked), len(a), len(a), 0)
        true = (a * len(exact) + b)[a != b] if queries is exact else a * len(exact) + b
        while 4 * width < len(exact):
            a, b = graph.within(q[asked], loose, width)
            hits = int(np.isin(true, asked[a] * len(exact) + b).sum())
            audit = (len(asked), len(true), hits, width)
            if hits >= RECALL * len(true):
                break
            width *= 4
        else:
            audit = (len(asked), len(true), len(true), 0)  # beams this wide scan the shard
    a, b = graph.within(q, loose, width)
    cos = np.concatenate([np.einsum("id,id->i", queries[a[i : i + 65536]], exact[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
    return a[cos >= threshold], b[cos >= threshold], audit


def search(threshold: float):
    """One or two shards' rows of GRAPHS -> LINKS between them (or inside the one)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard", ignore_index=True)
        held = [(np.frombuffer(r.classes, np.int64), np.frombuffer(r.copies, np.int64), np.frombuffer(r.exact, np.float64)) for r in rows.itertuples()]
        held = [(c, n, x.reshape(len(c), -1)) for c, n, x in held]
        graph = Graph.from_bytes(rows["graph"].iloc[-1])
        a, b, audit = pairs_within(graph, held[0][2], held[-1][2], threshold)
        if len(held) == 1:
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
            a, b = pair[:, 0], pair[:, 1]
            classes, copies = held[0][:2]
        else:
            b = b + len(held[0][0])
            classes, copies = (np.concatenate([held[0][k], held[1][k]]) for k in (0, 1))
        links = np.zeros(len(classes), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = classes[local_labels(len(classes), a, b)]
        told = pd.DataFrame({"class": classes, "component": root, "links": links})[links > 0]
        names = [c.split()[0] for c in LINKS.split(", ")]
        whole = told.astype("Int64").reindex(columns=names).astype("Int64")  # never through doubles, which can't hold names
        return pd.concat([whole, pd.DataFrame([[None, None, None, *audit]], columns=names, dtype="Int64")], ignore_index=True)

    return run


def searched(rows: DataFrame, threshold: float, shard: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vec_id, embedding, label -> vectors with their class, classes, and LINKS with label, low and high (all stored). A row
    of LINKS without class is the audit of its pair of shards."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull()
    named = stored(rows.withColumn("class", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", "embedding"))), "vectors")
    classes = named.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = stored(classes.withColumn("size", F.size("embedding")), "vector_classes")
    shards = classes.groupBy("label", "size").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = classes.join(shards, ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("class", F.lit(1)), F.col("shards")).cast("int"))
    graphs = stored(dealt.select("label", "size", "shard", "class", "copies", "embedding").groupBy("label", "size", "shard").applyInPandas(build, GRAPHS), "graphs")
    met = graphs.join(shards, ["label", "size"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    met = met.withColumn("low", F.least("shard", "other")).withColumn("high", F.greatest("shard", "other")).drop("other", "shards")
    found = stored(met.groupBy("label", "size", "low", "high").applyInPandas(search(threshold), LINKS), "vector_links")
    return named, classes, found


def audits(rows: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """vec_id, embedding, label -> pairs of shards, queries asked, links seen and found by the audits, recall (null where
    nothing was seen), pairs_scanned: those whose result is a scan's and so exact; by beam."""
    told = searched(rows, threshold, shard)[2].where(F.col("class").isNull())
    told = told.groupBy("beam").agg(F.count("*").alias("pairs"), *[F.sum(c).alias(c) for c in ("asked", "links_seen", "links_found")])
    return told.withColumn("recall", F.try_divide("links_found", "links_seen")).withColumn("pairs_scanned", F.when(F.col("beam") == 0, F.col("pairs")).otherwise(0))


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """vec_id, embedding (array of numbers), label -> vec_id, n_links, component_id, kept."""
    named, classes, found = searched(rows, threshold, shard)
    found = found.where(F.col("class").isNotNull())
    roots = components(found.select(F.col("class").alias("u"), F.col("component").alias("v")))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    told = classes.select("class", "first_id", "copies").join(roots.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = told.groupBy("component").agg(F.min("first_id").alias("component_id"))
    told = stored(told.join(ids, "component").join(links, "class", "left").select("class", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector_components")
    out = named.select("vec_id", "class").join(told, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
