"""Mixing, packing, line dedup, URL filters and the pipeline, edge cases included."""

import itertools
import random
import time
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_similar import brute_join
from test_text_rules import WORD, plain_quality

from galewatch.llm import line_dedup, mixing, packing, url_filter

EPOCHS, WEIGHTS = 3, (5, 2, 1)


def plain_targets(sizes):
    """source -> size; targets by raising the level until nothing is above its stop."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > EPOCHS * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = float(EPOCHS * sizes[s])
            left -= out[s]
        free -= over
    return out


def mix_rows():
    rng = random.Random(2)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(0, 40))), rng.choice(["a", "a", "a", "a", "b", "c", "d", None, "Z"]), 1) for i in range(400)]
    return rows + [(500, None, "a", 1), (501, "", None, 1), (None, "x y z", "b", 1), (3, rows[3][1], rows[3][2], 1)]


def test_mix_reaches_targets(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, text_hash int")
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["taken"] <= EPOCHS * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 40
    assert 0 <= sum(sizes.values()) - sum(taken.values()) <= 40
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))  # reruns agree
    copies = Counter((r["doc_id"], r["text"]) for r in mixing.repeated(docs).collect())
    times = Counter()
    text = {(d, s): t for d, t, s, _ in rows}
    for r in got:
        if r["epochs_taken"]:
            times[r["doc_id"], text[r["doc_id"], r["source"]]] += r["epochs_taken"]
    assert copies == times
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.repeated(docs.where("false")).count() == 0


@pytest.mark.parametrize("case", ["no words", "one source", "one long text", "many sources"])
def test_mix_of_odd_sources(spark, case):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 3}") for i in range(60)]
    if case == "no words":
        rows += [(100 + i, t, s) for i, (t, s) in enumerate([(None, "zero"), ("", "zero"), (None, None), (" ", "s1"), (None, "a")])]
    elif case == "one source":
        rows = [(i, t, "only") for i, t, _ in rows]
    elif case == "one long text":
        rows.append((100, "w " * 5000, "s1"))
    else:
        rows = [(i, "w " * (i % 9 + 1), f"host{i % 4000}") for i in range(6000)]
    size = lambda t: len((t or "").split())
    sizes, taken, most = defaultdict(int), Counter(), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
        most[s] = max(most[s], size(t))
    want = plain_targets(sizes)
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= EPOCHS * r["size"] and (r["finish"] is None) == (want[r["source"]] == 0)
        taken[r["source"]] += r["taken"]
    assert sum(sizes.values()) - max(most.values()) < sum(taken.values()) <= sum(sizes.values())
    if case != "many sources":
        assert all(abs(taken[s] - want[s]) <= 2 * max(most.values()) for s in sizes)


def test_mix_with_equal_finish_times(spark):
    rows = [(i, "a b c", s) for i in range(8) for s in ("x", "y", "z", "w", "v", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1,)).collect()
    assert {r["target"] for r in got} == {24.0} and len({r["finish"] for r in got}) == 8
    assert all(r["epochs_taken"] == 1 for r in got)
    assert sorted(map(str, mixing.mix(docs.repartition(5), weights=(1,)).collect())) == sorted(map(str, got))


def test_mix_spreads_rows_without_ids(spark, monkeypatch):
    """Rows without doc_id are dealt by their text, and rows that repeat both are one row until they are ranked."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    largest = []

    def watched(df, group, bucket, order, value, out, whole=mixing.running_total):
        if value == "words":
            largest.append(max(r["count"] for r in df.groupBy(*group, bucket).count().collect()))
        return whole(df, group, bucket, order, value, out)

    monkeypatch.setattr(mixing, "running_total", watched)
    docs = spark.range(12_000).selectExpr("cast(null as long) doc_id", "case when id < 6000 then concat('w w w t', id) when id < 10000 then 'same text' end text", "'s' source")
    got = mixing.mix(docs).collect()
    assert len(got) == 12_000 and max(largest) < 200
    sizes = Counter((r["size"], r["taken"]) for r in got)
    assert sum(n for (s, _), n in sizes.items() if s == 4) == 6000 and sum(n for (s, _), n in sizes.items() if s == 2) == 4000
    assert sum(s * n for (_, s), n in sizes.items()) == 32_000 and sum(mixing.repeated(docs).groupBy("text").count().toPandas()["count"]) > 0
    assert len({(r["size"], r["finish"]) for r in got if r["size"] == 2}) == 4000  # each has a place of its own


def plain_padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())


@pytest.mark.parametrize("buckets", [1, 2, 3, 9])
def test_boundaries_are_optimal(buckets):
    rng = random.Random(buckets)
    for _ in range(20):
        h = {rng.randrange(1, 30): rng.randrange(1, 9) for _ in range(8)}
        got = packing.boundaries(h, buckets)
        lengths = sorted(h)
        best = min(plain_padding(h, [*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k))
        assert plain_padding(h, got) == best and len(got) <= buckets
    assert packing.boundaries({}, buckets) == []


def check_packing(rows, lengths, max_length, buckets, batch_tokens):
    pieces = Counter()
    for n in lengths:
        pieces.update([(0)] if n == 0 else [min(max_length, n - p) for p in range(0, n, max_length)])
    assert Counter(r["length"] for r in rows) == pieces
    ends = packing.boundaries({k: v for k, v in pieces.items() if k}, buckets)
    full = defaultdict(list)
    for r in rows:
        if r["length"] == 0:
            assert r["batch"] is None
            continue
        assert r["bucket_length"] == min(e for e in ends if e >= r["length"]) and r["padding"] == r["bucket_length"] - r["length"]
        full[r["bucket_length"], r["batch"]].append(r["slot"])
    for (length, _), slots in full.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * length <= max(batch_tokens, length)
    for length in {k[0] for k in full}:
        batches = sorted(k[1] for k in full if k[0] == length)
        assert batches == list(range(len(batches)))
        assert all(len(full[length, b]) == max(1, batch_tokens // length) for b in batches[:-1])


def test_packing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("x" for _ in range(rng.choice([1, 3, 5, 20, 21, 75]))), "k") for i in range(300)] + [(1, "x x", "k"), (1, "x x", "k"), (None, "x", "k"), (1007, None, "k"), (1008, " ", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = packing.pack(docs, 50, 3, 100).collect()
    check_packing(got, [len(WORD.findall(t or "")) for _, t, _ in rows], 50, 3, 100)
    assert packing.pack(docs.where("false")).count() == 0
    assert packing.pack(docs.where("doc_id = 1007")).collect()[0]["batch"] is None


def plain_lines(rows, ratio, whole):
    """(site, text) -> text without boilerplate."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    pages, on = Counter(s for s, _ in rows), Counter()
    for s, t in rows:
        on.update({(s, strip(x)) for x in (t or "").split("\n") if strip(x)})
    out = []
    for s, t in rows:
        if t is None:
            out.append(None)
            continue
        keep = [x for x in t.split("\n") if not strip(x) or on[s, strip(x)] < 2 or on[s, strip(x)] <= ratio * pages[s]]
        out.append(t if whole and not any(map(strip, keep)) else "\n".join(keep))
    return out


@pytest.mark.parametrize("whole", [False, True])
def test_line_dedup(spark, whole):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None, ""]), "\n".join(rng.choice(["menu", " menu\r", "", "own %d" % rng.randrange(10**6), "rare %d" % rng.randrange(30)]) for _ in range(rng.randrange(1, 6)))) for _ in range(200)]
    rows += [("a", None), ("a", ""), ("small", "menu"), ("a", "menu\nmenu")]
    df = spark.createDataFrame([(i, s, t, "z", [1]) for i, (s, t) in enumerate(rows)], "id int, site string, text string, host string, dropped array<int>")
    got = {r["id"]: r["text"] for r in line_dedup.drop_lines(df, "site", "text", 0.2, whole).collect()}
    assert [got[i] for i in range(len(rows))] == plain_lines(rows, 0.2, whole)
    assert line_dedup.drop_lines(df.where("false"), "site", "text").count() == 0


def test_url_filter(spark):
    day = lambda d: datetime(2024, 1, d)
    entries = [("Bad.example", "spam", "add", day(2)), ("bad.example", "spam", "remove", day(5)), ("bad.example", "spam", "add", day(8)), ("bad.example", "adult", "add", day(4)), ("ok.example/x", "spam", "add", day(1)), ("tie.example", "spam", "add", day(1)), ("tie.example", "spam", "remove", day(1)), (None, "spam", "add", day(1)), ("n.example", "spam", "add", None), ("Deep.example/a/B", "scam", "add", day(1))]
    captures = [("https://www.BAD.example:80/p?q", day(1)), ("https://www.bad.example/p", day(2)), ("http://bad.example", day(5)), ("http://bad.example", day(9)), ("http://notbad.example", day(9)), ("http://ok.example/x/y", day(3)), ("http://ok.example/xy", day(3)), ("http://tie.example", day(3)), (None, day(3)), ("bad.example", day(3)), ("http://bad.example", None), ("http://n.example/", day(3)), ("http://www.deep.example/a/B/c?d", day(3)), ("http://deep.example/a/b", day(3)), ("http://deep.example/a", day(3)), ("http://www.ok.example/x", day(3))]
    got = url_filter.filter_urls(spark.createDataFrame([(i, u, t, "x") for i, (u, t) in enumerate(captures)], "id int, url string, fetched_at timestamp, pattern string"), spark.createDataFrame(entries, "pattern string, list string, action string, at timestamp"))
    assert {r["id"]: r["lists"] for r in got.collect()} == dict(enumerate([[], ["spam"], ["adult"], ["adult", "spam"], [], ["spam"], [], [], [], [], [], [], ["scam"], [], [], ["spam"]]))


def test_url_filter_long_urls(spark):
    """Time in proportion to length, whatever the numbers of segments and labels that the list has."""
    day = datetime(2024, 1, 1)
    deep = "/".join(f"s{i}" for i in range(50_000))
    patterns = ["a.example", "a.example/s0/s1", f"a.example/{'/'.join(f's{i}' for i in range(3000))}", "b.example/s0/s1/x", ".".join(["w"] * 40) + ".c.example", *(f"d{i}.example/" + "/".join("x" * i) for i in range(1, 60))]
    captures = [f"http://www.a.example/{deep}", f"http://b.example/{deep}", "http://" + ".".join(["w"] * 20_000) + ".c.example/p", "http://d59.example/" + "/".join("x" * 58), "http://e.example/" + "?" * 50_000, "http://e.example" + "/" * 50_000]
    rows = spark.createDataFrame(list(enumerate(captures)), "id int, url string").withColumn("fetched_at", F.lit(day))
    entries = spark.createDataFrame([(p, f"l{i}", "add", day) for i, p in enumerate(patterns)], "pattern string, list string, action string, at timestamp")
    began = time.perf_counter()
    got = {r["id"]: r["lists"] for r in url_filter.filter_urls(rows, entries).collect()}
    assert got == {0: ["l0", "l1", "l2"], 1: [], 2: ["l4"], 3: [], 4: [], 5: []} and time.perf_counter() - began < 15


@pytest.mark.parametrize("html", ["<!--", "<script>", "<p ", "<", "<head>x</he", "<style"])
def test_page_lines_of_hostile_pages(spark, html):
    text = "begin<br>" + html * (1_000_000 // len(html))
    began = time.perf_counter()
    got = spark.createDataFrame([(text,)], "html string").select(line_dedup.page_lines(F.col("html"))).first()[0]
    assert time.perf_counter() - began < 10 and got.startswith("begin\n")


def test_line_dedup_replaces_its_own_columns(spark):
    df = spark.createDataFrame([("a", "x\ny", "old", 1), ("a", "x", "old", 2)], "site string, text string, _n_lines string, _n_dropped int")
    got = line_dedup.drop_lines(df, "site", "text", 0.2)
    assert sorted(got.columns) == ["_n_dropped", "_n_lines", "site", "text"]
    assert sorted((r["text"], r["_n_lines"], r["_n_dropped"]) for r in got.collect()) == [("", 1, 1), ("y", 2, 1)]


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(11)
    text = lambda: "\n".join(" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 30))) for _ in range(6))
    rows = [(i, ("site notice\n" if i % 3 == 0 else "") + text(), "en", rng.choice(["a", "a", "b", "c"]), 5) for i in range(150)]
    rows += [(200 + i, rows[i][1].replace("w1", "w2", i % 3), "en", "b", 5) for i in range(20)] + [(300, None, "en", "a", 5), (301, "few words", None, None, None), (302, "again " * 80, "en", "a", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        seen.append([r.asDict() for r in docs.collect()])
        if k < 4:
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    kept = [r for r in rows if plain_quality(r[1])[-1]]
    assert sorted(r["doc_id"] for r in seen[0]) == sorted(r[0] for r in kept) and len(kept) < len(rows)
    cut = plain_lines([(r[3], r[1]) for r in kept], 0.1, True)
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in seen[1]} == {(r[0], t, len(t) if t != r[1] else r[4]) for r, t in zip(kept, cut)}
    assert any(t != r[1] for r, t in zip(kept, cut))
    joined = brute_join([(r[0], t) for r, t in zip(kept, cut)], 5, 4, 5)
    assert sorted(r["doc_id"] for r in seen[2]) == sorted(d for d, _, _, c in joined if d == c) and len(seen[2]) < len(seen[1])
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in seen[2]}
    sizes, taken = defaultdict(int), Counter()
    for r in seen[2]:
        sizes[r["source"]] += size[r["doc_id"]]
    for r in seen[3]:
        taken[r["source"]] += size[r["doc_id"]]
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= 2 * max(size.values())
    assert max(Counter(r["doc_id"] for r in seen[3]).values()) <= EPOCHS
    check_packing(seen[4], [size[r["doc_id"]] for r in seen[3]], packing.MAX_LENGTH, packing.BUCKETS, packing.BATCH_TOKENS)
    assert len(seen[4]) == pipeline.run(spark, str(tmp_path)).count()
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
