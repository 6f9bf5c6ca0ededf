"""The similarity join, vector graphs, components and repeat removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL

from galewatch.llm import ngram_join, repeat_removal, vector_dedup
from galewatch.llm.components import components
from galewatch.llm.hnsw import Graph


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(600, 700)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7), (-5, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges + edges[:9] + [(None, 3)], "u long, v long")).collect()}
    want = roots({n for e in edges for n in e}, edges)
    assert {n: got.get(n, n) for n in want} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text, k):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_join(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    links = [(i, j) for j in range(len(rows)) for i in range(j) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    count = Counter(x for p in links for x in p)
    root = roots(range(len(rows)), links)
    name = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            name[root[i]] = min(name.get(root[i], doc), doc)
    return sorted((doc, len(sets[i]), count[i], doc if not sets[i] else name.get(root[i])) for i, (doc, _) in enumerate(rows))


def near_copies(seed=1, groups=12, words=80):
    rng = random.Random(seed)
    rows = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "One two"), (-5, "one TWO"), (-6, "É"), (-7, "é")]
    passage = [f"p{i}" for i in range(30)]
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, words, 3 * words]))] + (passage if g % 2 else [])
        for _ in range(rng.choice([1, 2, 5, 24])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(50)}"
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    return rows + [rows[-1]]


def joined(docs, *rule):
    links = Counter((r["doc_id"], r["n_links"]) for r in ngram_join.count_links(docs, *rule).collect())
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_ngrams(docs, *rule).collect()), links


@pytest.mark.parametrize("k,num,den,few,hot,levels", [(4, 85, 100, 16, 1 << 20, 6), (5, 4, 5, 2, 3, 1), (4, 1, 2, 2, 1 << 20, 6), (3, 1, 1, 2, 3, 2)])
def test_join_equals_brute_force(spark, monkeypatch, k, num, den, few, hot, levels):
    for name, value in (("FEW", few), ("BLOCK", 4), ("CHUNK", 3), ("GROUP", few + 1), ("HOT", hot), ("HOT_MEANS", 0), ("LEVELS", levels)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, class string, shingle int")
    got, links = joined(docs, k, num, den)
    want = brute_join(rows, k, num, den)
    assert got == [(d, n, c) for d, n, _, c in want]
    assert links == Counter((d, n) for d, _, n, _ in want)


def copies_of_copies(seed, n=150, words=120):
    """A large group whose members are edited copies of each other, half of them too far apart, and a shared passage."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(60)}" for _ in range(words)]
    texts = [base]
    for i in range(n):
        own = list(rng.choice(texts[:6] if rng.random() < 0.7 else texts))
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[f"y{rng.randrange(40)}"], [], [own[at], f"u{i}"]])
        texts.append(own)
    passage = [f"q{i}" for i in range(70)]
    texts += [[*passage, *(f"t{i}v{j}" for j in range(rng.randrange(12)))] for i in range(60)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,few,levels", [(1, 4, 6), (3, 2, 2)])
def test_large_groups_equal_brute_force(spark, monkeypatch, seed, few, levels):
    for name, value in (("FEW", few), ("BLOCK", 16), ("CHUNK", 20), ("GROUP", 3 * few), ("LEVELS", levels)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = copies_of_copies(seed)
    got, _ = joined(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    want = [(d, n, c) for d, n, _, c in brute_join(rows, 4, 85, 100)]
    assert got == want
    assert 20 < len({c for _, _, c in want}) < 190


def edited_family(rng, name, n, words):
    """n texts, each edited from one of the others, so that similarities lie on both sides of the threshold."""
    texts = [[f"{name}w{rng.randrange(3 * words)}" for _ in range(words)]]
    while len(texts) < n:
        own = list(rng.choice(texts[-40:] if rng.random() < 0.8 else texts))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.choice([rng.randrange(len(own)), len(own) - 1, 0])
            own[at : at + 1] = rng.choice([[f"{name}e{rng.randrange(30)}"], [], [own[at], f"{name}u{len(texts)}"]])
        texts.append(own)
    return texts


def exact_pair(name, others):
    """Two texts of 55 and 56 shingles that share 51 of 60, and others that share a part of these with both."""
    shared = [f"{name}s{i}" for i in range(54)]
    texts = [shared + [f"{name}a{i}" for i in range(5)], shared + [f"{name}b{i}" for i in range(4)]]
    return texts + [shared[10 : 20 + i % 25] + [f"{name}o{i}.{j}" for j in range(40)] for i in range(others)]


def test_join_at_its_own_settings(spark):
    """20 seeds of families, groups of 5 to 70 texts and one of 2,000, pairs at exactly 85 %, lists around FEW."""
    families = []
    for seed in range(20):
        rng = random.Random(seed)
        for g, n in enumerate((5, 12, 16, 17, 18, 33, 70)):
            families.append(edited_family(rng, f"f{seed}g{g}", n, rng.choice([20, 58, 59, 60, 140])))
        families += [exact_pair(f"p{seed}x{others}", others) for others in (0, 3, 14, 15, 16, 40)]
    families.append(edited_family(random.Random(99), "large", 2000, 70))
    rows, want, linked = [], {}, 0
    for family in families:
        first = len(rows)
        rows += [(first + i, " ".join(t)) for i, t in enumerate(family)]
        sets = [shingles(" ".join(t), 4) for t in family]
        links = []
        for j, b in enumerate(sets):
            for i in range(j):
                a = sets[i]
                if 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * (both := len(a & b)) >= 85 * (len(a) + len(b) - both):
                    links.append((first + i, first + j))
        linked += len(links)
        want |= roots(range(first, len(rows)), links)
    assert linked > 10_000 and len(set(want.values())) > 1000
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert {d: (c, want[d]) for d, c in got.items() if c != want[d]} == {} and len(got) == len(want)


def test_large_groups_do_not_meet_in_pairs(spark, monkeypatch):
    made, n = [], 1600
    monkeypatch.setattr(ngram_join, "compare", lambda found, *a, compare=ngram_join.compare: made.append(found.count()) or compare(found, *a))
    rng = random.Random(n)
    rows = []
    for i in range(n):
        own = [f"w{j}" for j in range(150)]
        for j in range(rng.randrange(6)):
            own[rng.randrange(150)] = f"e{i}.{j}"
        rows.append((i, " ".join(own)))
    ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).count()
    assert sum(made) < 10 * n


def test_join_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_ngrams(docs).collect()}
    assert got == {(None, 2, 4), (4, 2, 4)}
    assert {(r["doc_id"], r["n_links"]) for r in ngram_join.count_links(docs).collect()} == {(None, 2), (4, 2)}
    assert ngram_join.join_ngrams(docs.where("false")).count() == ngram_join.count_links(docs.where("false")).count() == 0
    assert ngram_join.keep_first(docs).collect() == [(4, "a b c d e f")]
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven"), (1, None), (1, None), (1, ""), (None, None), (2, "One two three four five six")]
    kept = ngram_join.keep_first(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string")).collect()
    assert sorted(((r[0], r[1]) for r in kept), key=str) == sorted([rows[0], rows[1], rows[2], rows[4], rows[5]], key=str)


def test_divide_skip_on_small_sets():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**60, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 180, replace=False), rng.integers(0, 2**60, int(n)).astype(np.uint64)])) for n in rng.integers(0, 40, 60)]
    sets.sort(key=len)
    side = rng.integers(0, 2, 60)
    got = set(zip(*map(np.ndarray.tolist, ngram_join.divide_skip(sets, side, 3, 4))))
    size = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    assert got == {(a, b) for b in range(60) for a in range(b) if side[a] != side[b] and 4 * size(a, b) >= 3 * (len(sets[a]) + len(sets[b]) - size(a, b))}


def test_graph_recall():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(150, 32))
    x = np.repeat(centers, 12, axis=0) + 0.12 * rng.normal(size=(1800, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, order = Graph.built(x.astype(np.float32), rng.random(len(x)))
    x = x[order]
    true = x @ x.T >= 0.93
    a, b, _ = vector_dedup.pairs_within(Graph.from_bytes(graph.to_bytes()), x, x, 0.93)
    assert true[a, b].all() and len(set(zip(a, b))) >= 0.98 * true.sum()
    near, _ = graph.beam(x[:200].astype(np.float32), np.zeros((200, 1), np.int32), 64, 0)
    top = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(n) & set(t)) for n, t in zip(near.tolist(), top.tolist())]) >= 9


@pytest.mark.parametrize("shard", [8192, 40])
def test_vectors_equal_brute_force(spark, shard):
    rng = np.random.default_rng(9)
    rows = []
    for c in rng.normal(size=(40, 8)):
        for _ in range(int(rng.integers(1, 7))):
            rows.append([len(rows), [float(v) for v in np.float32(c + 0.1 * rng.normal(size=8))], int(rng.integers(0, 2))])
    rows += [[len(rows) + i, list(rows[5][1]), rows[5][2]] for i in range(3)]
    n = len(rows)
    rows += [[n, None, 1], [n + 1, [0.0] * 8, 1], [n + 2, [float("nan")] * 8, 1], [n + 3, [None] * 8, 1], [n + 4, rows[0][1], None], [n + 5, [], 1], [n + 6, [1.0, 2.0], 1], [n + 7, [1.0, 2.0], 1]]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, label int, class string, shard int")
    links = []
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    for i in unit:
        for j in unit:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links.append((i, j))
    count, root = Counter(x for p in links for x in p), roots(range(len(rows)), links)
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_dedup.near_vectors(df, shard=shard).collect()}
    assert got == {i: (count[i], root[i], root[i] == i) for i in range(len(rows))}
    assert vector_dedup.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("shard", [4096, 500])
def test_vectors_through_graphs(spark, shard):
    """Shards of more than 256 vectors, which are searched through their graphs, in one shard and across several."""
    rng = np.random.default_rng(21)
    centers = rng.normal(size=(420, 24))
    x = np.concatenate([np.repeat(centers, 3, axis=0) + 0.05 * rng.normal(size=(1260, 24)), rng.normal(size=(300, 24))])
    df = spark.createDataFrame([(i, [float(v) for v in row], 7) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.93, 1))
    count, root = Counter([*a.tolist(), *b.tolist()]), roots(range(len(x)), list(zip(a.tolist(), b.tolist())))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(df, shard=shard).collect()}
    found = sum(n for n, _ in got.values())
    assert all(n <= count[i] for i, (n, _) in got.items())  # cosines are verified: no link is made up
    assert found >= 0.99 * sum(count.values()) > 2000  # the recall that audits ask for
    assert sum(got[i][1] == root[i] for i in got) >= 0.99 * len(x)
    told = vector_dedup.audits(df, shard=shard).collect()
    pairs = {4096: 1, 500: 10}[shard]  # four shards against each other and themselves
    assert sum(r["pairs"] for r in told) == pairs and all(r["recall"] is None or r["recall"] >= 0.99 for r in told) and sum(r["links_seen"] for r in told) > 100
    assert all((r["pairs_scanned"] == r["pairs"]) == (r["beam"] == 0) for r in told)


def test_bitmaps_grow_with_what_is_asked():
    assert [ngram_join.bitmap_bits(n) for n in (0, 1000, 1 << 20, 1 << 22, 1 << 40)] == [23, 23, 24, 26, 28]


def brute_repeats(texts, least):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        mask = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                mask[i : i + least] = b"\1" * least
        out.append((len(b), sum(mask), sum(1 for i in range(len(b)) if mask[i] and not (i and mask[i - 1])), hashlib.sha256(bytes(x for x, m in zip(b, mask) if not m)).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(3)]
    texts = [None, "", "short", "a" * 199, "a" * 200, "a" * 700, "ab" * 400, prose(100), prose(100)]
    for i in range(40):
        texts.append(prose(rng.randrange(1, 60)) + rng.choice(shared)[rng.randrange(80) :] + prose(rng.randrange(1, 30)))
    near = texts[-1]
    for _ in range(6):
        at = rng.randrange(len(near))
        texts.append(near[:at] + "#" + near[at + 1 :])
    return texts + [texts[8], texts[8], near[:150]]


@pytest.mark.parametrize("most", [20_000, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(repeat_removal, "MOST", most)
    monkeypatch.setattr(repeat_removal, "TOGETHER", 64)
    texts = repeat_texts()
    spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, class string, spans int").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in repeat_removal.op6_repeat_removal(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200)


def test_cut_texts(spark):
    texts = repeat_texts()[:30]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[10])], "doc_id long, text string")
    got = [(r["doc_id"], hashlib.sha256(r["kept"]).hexdigest()) for r in repeat_removal.cut_texts(docs).collect()]
    want = brute_repeats([*texts, texts[10]], 200)
    assert sorted(got, key=str) == sorted([(i if i < len(texts) else None, w[3]) for i, w in enumerate(want)], key=str)
    assert repeat_removal.find_repeats(docs.where("false")).count() == 0


def test_join_over_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.op1_ngram_join(spark, SMALL).collect())
    assert got == [(d, n, c) for d, n, _, c in brute_join(rows, 4, 85, 100)]
