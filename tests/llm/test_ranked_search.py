"""Ranked search through treaps against scoring every document, and against its SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL, same

from galewatch.llm import ranked_search as search


def test_equals_sql(spark):
    assert same(spark, SMALL, search.op11_ranked_search, search.ORACLE) == 400


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=10):
    """Rows of (item_id, rank, doc_id, score), each query by itself."""
    counted = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    counted = [d for d in counted if d[2]]
    n_docs, n_words = len(counted), sum(d[2] for d in counted)
    df = Counter(t for d in counted for t in d[1])
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for doc, tf, n in counted:
            m = 25 + 75 * n * n_docs // n_words
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, times in Counter(words(text)).items())
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    """Lengths rise with doc_id, some words are common, and groups of equal texts tie."""
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}é" for i in range(300)]
    docs = [(i, " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(1 + i // 8))) for i in range(n)]
    docs += [(n + i, docs[n // 2][1].upper()) for i in range(40)]
    rng.shuffle(docs)
    return docs, [(i, " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.randrange(1, 30)))) for i in range(12)]


@pytest.mark.parametrize(("shard_docs", "wave", "leaf"), [(1 << 14, 64, 16), (37, 2, 1), (500, 1, 3)])
def test_equals_brute_force(spark, monkeypatch, shard_docs, wave, leaf):
    monkeypatch.setattr(search, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(search, "WAVE", wave)
    monkeypatch.setattr(search, "LEAF", leaf)
    monkeypatch.setattr(search, "BLOCK_TERMS", 40)
    docs, items = corpus(shard_docs, 400)
    got = search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, items)


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(4)
    for impacts in (np.arange(1, 3001), np.full(3000, 7), rng.integers(1, 50, 3000), np.arange(3000, 0, -1)):
        doc = np.sort(rng.choice(10_000, 3000, replace=False))
        t = search.build_treaps(np.full(3000, 1), doc, impacts, 3)
        assert t.root[0] == t.root[2] == 0
        seen, stack, depth = [], [(int(t.root[1]), -1, 10_000, 1)], 0
        while stack:
            node, low, high, at = stack.pop()
            depth = max(depth, at)
            assert low < t.doc[node] < high
            seen.append(t.doc[node])
            for child, a, b in ((int(t.left[node]), low, t.doc[node]), (int(t.right[node]), t.doc[node], high)):
                if child:
                    assert t.top[child] <= t.top[node]
                    stack.append((child, a, b, at + 1))
        assert sorted(seen) == doc.tolist() and t.top[t.root[1]] == impacts.max() and depth < 300


def test_pruning_skips_documents(monkeypatch):
    """With one heavy term in few documents, most documents are never scored."""
    n = 4000
    ids, sizes = np.arange(n), np.full(n, 2)
    sizes[::400] = 3
    term = np.concatenate([[0, 1, 2] if s == 3 else [0, 1] for s in sizes])
    shard = search.make_shard(ids, np.full(n, 50), sizes, term, np.ones(len(term), np.int64), n, 50 * n, 3)
    scored, plain = [], search.Shard.scores
    monkeypatch.setattr(search.Shard, "scores", lambda self, docs, weights: scored.append(len(docs)) or plain(self, docs, weights))
    monkeypatch.setattr(search, "WAVE", 8)
    weights = np.array([1, 1, 900])
    none = np.zeros(0, np.int64)
    best = search.search(shard, np.arange(3), weights, weights, search.Best(none, none), 10)
    assert best.doc_id.tolist() == list(range(0, n, 400)) and sum(scored) < n / 4


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, "!? \x00"), (None, "red fox"), (4, "red fox"), (4, "red fox"), (5, "RED  Fox_fox"), (6, "x " * 100_000 + "fox"), (7, "é É"), (8, "blue")]
    items = [(1, "fox red"), (1, "fox red"), (1, "Blue?"), (None, "É"), (2, None), (3, "..."), (4, "unknown"), (5, "the " * 50_000 + "fox")]
    table = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id int, text string, score int, terms string")
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id int, text string, block int")
    got = search.ranked(table, asked)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, items)
    assert search.ranked(table.where("false"), asked).count() == 0 == search.ranked(table, asked.where("false")).count()
