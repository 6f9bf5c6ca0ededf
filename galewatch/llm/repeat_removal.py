"""Removal of byte strings that repeat anywhere in the corpus, by a column-wise multi-document construction.

A string of LEAST bytes repeats when an equal one starts elsewhere, in the same or another document. Every such string
names an anchor by its own bytes alone: the gram of GRAM bytes with the smallest hash, the leftmost of equals. So equal
strings have equal anchors at equal distances, and the documents' contexts around one anchor are aligned at it.

1. Texts that are equal are one class; a class of several documents repeats as a whole.
2. Anchors of one text of each class are counted by gram; those whose gram occurs once can't repeat and go.
3. The contexts of the rest meet by gram. Equal contexts are told once per task and counted before they meet.
4. Contexts that share an anchor are indexed together, column by column: each round inserts one byte per context into
   the positional Burrows-Wheeler order, and updates the common prefixes (read from the right: how far back neighbours
   agree). A context whose neighbour agrees on the last LEAST bytes holds a repeated string that ends at this column.
5. A gram with more than MOST contexts is split by the strings' distances from the anchor, in halves, and each half by
   the bytes that all its strings hold. Rounds of this end at single distances, where equal strings are one context.

The rounds of the published construction run through sequential external files over whole documents: a round for each
of a text's bytes, each of which passes over all that was built. Here the collection is cut into contexts of at most
2 * LEAST - GRAM bytes, so there are as many rounds at most, and what a round updates fits in a task's memory.

Defined cases: a null text is empty; a text shorter than LEAST has no such string; a null doc_id is kept; repeated rows
are documents with equal texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewatch.llm.common import bitmap_bits, stored, table, text_of
from galewatch.llm.wordarrays import byte_texts, chunks

LEAST, GRAM = 200, 32
#: Contexts of one gram that are indexed in one piece, and contexts that are indexed at once.
MOST, TOGETHER = 20_000, 8192
CONTEXT = "gram long, name long, class long, at int, low int, high int, content binary"


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width, factor = 1, 0xBF58476D1CE4E5B9
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, (factor * 0x94D049BB133111EB + 2) % 2**64 | 1
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(raw: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """document, gram, at, low, high: the anchors of texts joined in `raw`.

    at: place in the document; the strings that start from low to high - 1 bytes before it have this anchor.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(raw) < least:
        return none
    h = gram_hashes(raw)
    best = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width, grams = 1, least - GRAM + 1
    while 2 * width <= grams:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[: len(raw) - least + 1], best[grams - width : grams - width + len(raw) - least + 1])
    place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(place)]
    start = np.flatnonzero(np.arange(len(place)) + least <= starts[doc + 1])  # strings inside one document
    if not len(start):
        return none
    place, doc = place[start], doc[start]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:], len(start)] - 1
    p, d = place[first], doc[first]
    return d, h[p].view(np.int64), p - starts[d], p - start[last], p - start[first] + 1


def found_anchors(least: int):
    """class, text -> gram, class, at, low, high; each class once per task."""
    names = ["gram", "class", "at", "low", "high"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in source:
            classes, texts = [], []
            for c, t in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                if len(t) >= least and c not in seen:
                    seen.add(c)
                    classes.append(c)
                    texts.append(t)
            for a, b in chunks(texts):
                starts = np.r_[0, np.cumsum([len(t) for t in texts[a:b]])].astype(np.int64)
                d, gram, at, low, high = anchors(np.frombuffer(b"".join(texts[a:b]), np.uint8), starts, least)
                own = np.array(classes[a:b], np.int64)[d]
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(own), *(pa.array(x.astype(np.int32)) for x in (at, low, high))], names)

    return run


def context_name(gram: int, low: int, high: int, content: bytes) -> int:
    name = xxhash.xxh3_64_intdigest(b"%d %d %d " % (gram, low, high) + content)
    return name - (1 << 64) if name >> 63 else name


def told_contexts(least: int):
    """class, text, marks -> CONTEXT: a row per mark; the content comes with a context's first row in a task only."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CONTEXT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        seen: set[int] = set()
        rows: list[tuple] = []
        for batch in source:
            for c, text, marks in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2).to_pylist()):
                for m in marks:
                    gram, at, low, high = m["gram"], m["at"], m["low"], m["high"]
                    content = text[at - high + 1 : at - low + least]
                    name = context_name(gram, low, high, content)
                    rows.append((gram, name, c, at, low, high, None if name in seen else content))
                    seen.add(name)
                if len(rows) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return run


def repeated_strings(group: np.ndarray, low: np.ndarray, high: np.ndarray, contents: list[bytes], least: int) -> np.ndarray:
    """[row, k]: whether the string of `least` bytes that starts k bytes before row's anchor is in another row of its group.

    group: ascending. A round for each column inserts a byte of every row: rows of a group stay sorted by what they
    hold up to the column, read from the right, and since[i] is the column from which row order[i] and its
    predecessor agree.
    """
    n, reach = len(group), least - GRAM + 1
    first, end = -(high.astype(np.int64) - 1), least - low.astype(np.int64)
    left, right = int(first.min()), int(end.max())
    columns = np.full((right - left, n), 256, dtype=np.int16)  # 256: the row has no byte here
    for i, content in enumerate(contents):
        columns[first[i] - left : end[i] - left, i] = np.frombuffer(content, np.uint8)
    found = np.zeros((n, reach), dtype=bool)
    order, base = np.arange(n), group.astype(np.int64) * 257
    apart, head = right + 1, np.r_[True, group[1:] != group[:-1]]
    since = np.where(head, apart, left)
    for column in range(left, right):
        byte = columns[column - left][order]
        key = base + byte
        moved = np.argsort(key, kind="stable")
        new = np.full(n, column + 1, dtype=np.int64)
        same = np.flatnonzero(key[moved[1:]] == key[moved[:-1]])
        if len(same):  # of what lay between two rows that are neighbours now, the least agreement
            span = np.stack([moved[same] + 1, moved[same + 1] + 1], axis=1).ravel()
            new[same + 1] = np.maximum.reduceat(np.r_[since, apart], span)[::2]
        new[byte[moved] == 256] = column + 1
        new[head] = apart
        order, since = order[moved], new
        k = least - (column + 1)
        if 0 <= k < reach:
            hit = np.flatnonzero(since <= column + 1 - least)
            found[order[hit], k] = True
            found[order[hit - 1], k] = True
    return found


def runs(found: np.ndarray) -> list[list[dict]]:
    """The runs of true values of each row."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    out: list[list[dict]] = [[] for _ in found]
    for (row, low), (_, high) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist()):
        out[row].append({"low": low, "high": high})
    return out


SPANS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def indexed(least: int):
    """gram, name, low, high, content, sorted by gram -> name, spans: distances of strings that other contexts hold."""

    def judged(rows: dict[int, tuple]) -> pa.RecordBatch:
        group = np.unique([r[0] for r in rows.values()], return_inverse=True)[1]
        low, high = (np.array([r[k] for r in rows.values()], np.int32) for k in (1, 2))
        spans = runs(repeated_strings(group, low, high, [r[3] for r in rows.values()], least))
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(spans, SPANS)], ["name", "spans"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, own, ready = None, {}, {}
        for batch in source:
            for g, name, *row in zip(*(x.to_pylist() for x in batch.columns)):
                if g != gram:
                    if len(own) > 1:  # alone, a context has nothing to agree with
                        ready |= own
                    gram, own = g, {}
                    if len(ready) >= TOGETHER:
                        yield judged(ready)
                        ready = {}
                own[name] = (g, *row)
        if len(own) > 1:
            ready |= own
        if ready:
            yield judged(ready)

    return run


def halved(least: int):
    """gram, name, low, high, content, from, to -> the same for both halves of the distances from..to, with parent.

    The content comes with a name's first row in a task only.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
    names = ["gram", "name", "low", "high", "content", "from", "to", "parent"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in source:
            rows = []
            for gram, name, low, high, content, a, b in zip(*(x.to_pylist() for x in batch.columns)):
                for x, y in ((a, (a + b) // 2), ((a + b) // 2, b)):
                    l, h = max(low, x), min(high, y)
                    if l >= h:
                        continue
                    at = high - 1  # of the anchor in content
                    core = content[at - x : at - y + 1 + least]
                    part = content[at - h + 1 : at - l + least]
                    own = context_name(gram, x, y, core)
                    called = context_name(own, l, h, part)
                    rows.append((own, called, l, h, None if called in seen else part, x, y, name))
                    seen.add(called)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return run


def agreeing(contexts: DataFrame, least: int) -> DataFrame:
    """gram, name, low, high, content, from, to (rows of one name are equal) -> name, spans.

    Each name counts once; what several occurrences of one name mean is the caller's to add.
    """
    per_gram = contexts.select("gram", "name").distinct().groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("gram")
    columns = ["gram", "name", "low", "high", "content"]
    index = lambda rows: rows.select(*columns).repartition("gram").sortWithinPartitions("gram").mapInArrow(indexed(least), "name long, spans array<struct<low:int,high:int>>")
    hot = stored(per_gram, "hot_grams")
    if hot.isEmpty():
        return index(contexts)
    split = contexts.join(hot, "gram").where(F.col("to") - F.col("from") > 1).dropDuplicates(["name"])
    halves = stored(split.select(*columns, "from", "to").mapInArrow(halved(least), "gram long, name long, low int, high int, content binary, from int, to int, parent long"), "halves")
    deeper = agreeing(halves.where(F.col("content").isNotNull()).drop("parent"), least)
    spans = verdicts(halves.select("name", "low", "high"), deeper)
    joined = halves.select("name", "parent").join(spans, "name").groupBy("parent").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return index(contexts.join(hot, "gram", "left_anti")).unionAll(joined.select(F.col("parent").alias("name"), "spans"))


def verdicts(rows: DataFrame, agreed: DataFrame) -> DataFrame:
    """name, low, high of every occurrence; name, spans -> name, spans, at times two rows a name.

    A name that occurs twice repeats whole.
    """
    twice = rows.groupBy("name").agg(F.count("*").alias("n"), F.first("low").alias("low"), F.first("high").alias("high")).where(F.col("n") > 1)
    return twice.select("name", F.array(F.struct("low", "high")).alias("spans")).unionAll(agreed.where(F.size("spans") > 0).select("name", "spans"))


def merged(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class, spans (start, end) -> the same, overlapping and touching ones united, in order."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in source:
        out = []
        for spans in batch.column(1).to_pylist():
            own: list[dict] = []
            for s in sorted(spans, key=lambda s: s["start"]):
                if own and s["start"] <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], s["end"])
                else:
                    own.append(s)
            out.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["class", "spans"])


def class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text; class, first_id, ... -> class, text, ...: a text for each class that is asked for.

    A bitmap of bounded size (common.bitmap_bits), broadcast, keeps most other texts out of the join's shuffle.
    """
    n_bits = bitmap_bits(wanted.count())
    key = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(1 << n_bits)) + 1
    bits = wanted.select(key("class").alias("key")).groupBy(F.bitmap_bucket_number("key").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("_bits"))
    bits = stored(bits.select(F.col("_bucket"), "_bits"), "asked")  # 2**n_bits / 32768 rows of 4 KB at most
    texts = docs.select(F.col("doc_id").alias("_id"), text_of().alias("text")).withColumn("_class", F.xxhash64("text"))
    texts = texts.withColumn("_bucket", F.bitmap_bucket_number(key("_class"))).withColumn("_bit", F.bitmap_bit_position(key("_class")))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    texts = texts.join(F.broadcast(bits), "_bucket").where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1)
    return texts.select("_id", "_class", "text").join(wanted, (F.col("_class") == F.col("class")) & F.col("_id").eqNullSafe(F.col("first_id"))).drop("_id", "_class", "first_id")


def find_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text -> doc_id, class, n_bytes, spans: byte ranges (end exclusive) of the text that repeat, in order."""
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("class", F.xxhash64("text"))
    base = stored(texts.select("doc_id", "class", F.octet_length("text").cast("long").alias("n_bytes")), "text_classes")
    classes = stored(base.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes")), "classes")
    marks = texts.select("class", "text").mapInArrow(found_anchors(least), "gram long, class long, at int, low int, high int")
    # Not a window: a gram of a periodic text may hold a third of all anchors, and a join's hot side can be split.
    # (Where both of its sides are dealt for it: so the counts are written first.)
    again = stored(marks.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("gram"), "grams")
    marks = marks.join(again, "gram")
    marks = marks.groupBy("class").agg(F.collect_list(F.struct("gram", "at", "low", "high")).alias("marks"))
    wanted = stored(marks.join(classes.select("class", "first_id"), "class"), "marks")
    told = class_texts(docs, wanted).select("class", "text", "marks").mapInArrow(told_contexts(least), CONTEXT)
    told = stored(told, "contexts")
    contexts = told.where(F.col("content").isNotNull()).select("gram", "name", "low", "high", "content", F.lit(0).alias("from"), F.lit(least - GRAM + 1).alias("to"))
    found = stored(verdicts(told.select("name", "low", "high"), agreeing(contexts, least)), "repeats")
    spans = told.select("name", "class", "at").join(found, "name").select("class", F.transform("spans", lambda s: F.struct((F.col("at") - s["high"] + 1).cast("long").alias("start"), (F.col("at") - s["low"] + least).cast("long").alias("end"))).alias("spans"))
    spans = spans.groupBy("class").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(merged, "class long, spans array<struct<start:bigint,end:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = classes.join(spans, "class", "left").select("class", F.when((F.col("copies") > 1) & (F.col("n_bytes") >= least), whole).otherwise(F.coalesce("spans", none)).alias("spans"))
    return base.join(stored(spans.where(F.size("spans") > 0), "class_spans"), "class", "left").select("doc_id", "class", "n_bytes", F.coalesce("spans", none).alias("spans"))


def kept_bytes(text: Column, spans: Column) -> Column:
    """The bytes of a text outside the spans, as binary."""
    raw = F.encode(text, "UTF-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text).cast("long")))
    parts = F.zip_with(starts, ends, lambda a, b: F.hex(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))))
    return F.unhex(F.array_join(parts, ""))


def cut_texts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text -> doc_id, spans, kept: binary, since a span may end inside a character."""
    found = find_repeats(docs, least).select(F.col("doc_id").alias("_id"), F.col("class").alias("_class"), "spans").dropDuplicates(["_id", "_class"])
    texts = docs.select("doc_id", text_of().alias("text"))
    joined = texts.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_class")))
    return joined.select("doc_id", "spans", kept_bytes(F.col("text"), F.col("spans")).alias("kept"))


def op6_repeat_removal(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = stored(find_repeats(docs), "found")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    part = found.where((removed > 0) & (removed < F.col("n_bytes"))).groupBy("class").agg(F.min("doc_id").alias("first_id"), F.first("spans").alias("spans"))
    cut = class_texts(docs, stored(part, "cut")).select("class", F.sha2(kept_bytes(F.col("text"), F.col("spans")), 256).alias("kept")).dropDuplicates(["class"])
    plain = docs.select(F.xxhash64(text_of()).alias("class"), F.sha2(text_of(), 256).alias("plain")).dropDuplicates(["class"])
    out = found.withColumn("n_removed", removed).join(cut, "class", "left").join(plain, "class")
    kept = F.when(F.col("n_removed") == 0, F.col("plain")).when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit(""), 256)).otherwise(F.col("kept"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), kept.alias("kept_sha256"))
