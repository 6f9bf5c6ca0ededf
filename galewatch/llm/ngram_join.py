"""Similarity join of documents on word shingles, as a T-occurrence search with DivideSkip.

A document is its set of distinct shingles (64-bit names); documents with equal sets are one class. Two classes link
when their Jaccard similarity reaches a threshold, so each partner of a class of s shingles shares at least
T = ceil(threshold * s) of them.

1. Every class sets its T - c longest inverted lists aside, as DivideSkip does: partners then meet in c of the others
   at least. List lengths come from a counter sketch of fixed size over the whole corpus; any fixed order of the
   shingles gives the same links, lengths only decide how many candidates there are.
2. Lists are gathered by shingle. Those of up to FEW classes are merged: occurrences of a pair are counted (Spark sorts
   and merges them by pair), and a pair with fewer than c, or with too little after the first of them, is no candidate.
3. A longer list isn't listed pair by pair. One of its classes, that with the fewest rarer shingles, is its pivot and
   is compared with all others. Two classes that both link with the pivot are in one component and need not meet. For
   any other two, a and b, |a ^ b| = |a ^ p| + |b ^ p| - 2 |(a ^ p) & (b ^ p)|, and at least one of them is too far from
   the pivot p: so they link only if they share some of their differences from p, at least a known number of them. Each
   class is posted under its rarest differences, as many as that number asks for. Of these new and much shorter lists,
   those of up to FEW classes give pairs, those of up to GROUP are searched in one task each, as in 5, and longer ones
   get pivots of their own. After LEVELS rounds what is left of long lists goes to 5.
4. Two sets are compared by binary probes of one in the other.
5. Where links are counted, and for long lists that are left, classes are dealt to blocks, each two blocks that meet in
   a list or pair are a cell with the sets that met, and a local inverted index is searched in each cell by DivideSkip:
   short lists are merged and counted, candidates that may still reach their overlap are looked up in the long lists by
   binary search, and those that reach it are links.

The merges count instead of walking a heap: counting gives the same candidates from the same short lists.
Names of shingles and classes are 64-bit hashes: of n different texts, n*n / 2^65 pairs are expected to be mistaken.

Defined cases: a null text, or one without words, has no shingles, links with nothing and is its own component; a text
shorter than a shingle is one shingle; a null doc_id takes part, but is no component's name unless no other is there;
repeated rows are documents with equal sets; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galewatch.llm.common import bitmap_bits, stored, table
from galewatch.llm.components import components, local_labels
from galewatch.llm.wordarrays import byte_texts, mixed, shingle_set

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Counters for list lengths (4 bytes each on the wire, whatever the corpus) and their rows in a sketch.
SKETCH_BITS, SKETCH_ROWS = 20, 256
#: Classes of a list that is merged pair by pair; classes per block (a cell has two blocks); classes that are compared
#: with a pivot in one task; classes of a list of differences that is searched in one task; rounds of pivots.
FEW, BLOCK, CHUNK, GROUP, LEVELS = 16, 512, 512, 512, 4
#: A list that may be longer, by the sketch, is never gathered (nor if it may be HOT_MEANS times the mean counter).
HOT, HOT_MEANS = 1 << 20, 4
#: DivideSkip's weight of the merge against the probes.
MU = 0.5


def class_name(shingles: np.ndarray) -> int:
    name = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return name - (1 << 64) if name >> 63 else name


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(a, dtype=np.uint64).view(np.int64))


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def least_overlap(size: int, num: int, den: int) -> int:
    return -(-num * size // den)


def occurrences(size, num: int, den: int):
    """How often partners of such a set meet at least in the lists that it doesn't set aside (int or column)."""
    if isinstance(size, int):
        return min(3 + size // 100, least_overlap(size, num, den))
    return F.least(3 + F.floor(size / 100), F.floor((size * num + den - 1) / den))


def classes_and_sketch(words: int):
    """doc_id, text, text_hash -> a row per document, and SKETCH_ROWS rows of counters per task."""
    names = ["doc_id", "text_hash", "n_shingles", "class", "part", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, dtype=np.uint32), set()
        for batch in source:
            sizes, found = [], []
            for text in byte_texts(batch.column(1)):
                s = shingle_set(text, words)
                sizes.append(len(s))
                found.append(class_name(s) if len(s) else None)
                if len(s) and found[-1] not in seen:
                    seen.add(found[-1])
                    np.add.at(counts, bucket(s), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, kinds[2]), pa.array(found, kinds[3]), *(pa.nulls(len(sizes), k) for k in kinds[4:])], names)
        packed = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(SKETCH_ROWS, -1)]
        if seen:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(SKETCH_ROWS, k) for k in kinds[:4]), pa.array(range(SKETCH_ROWS), kinds[4]), pa.array(packed, kinds[5])], names)

    return run


def summed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in source:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(zlib.decompress(counts), dtype=np.uint32).astype(np.uint64)
            total[part] = total[part] + own if part in total else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes(), 1) for x in total.values()], pa.binary())], ["part", "counts"])


def list_lengths(rows: DataFrame) -> np.ndarray:
    """The summed sketch; it has 2**SKETCH_BITS counters on any corpus."""
    sketch = rows.where(F.col("part").isNotNull()).select("part", "counts").repartition(32, "part").mapInArrow(summed, "part int, counts binary").collect()
    out = np.zeros((SKETCH_ROWS, (1 << SKETCH_BITS) // SKETCH_ROWS), dtype=np.uint32)
    for part, counts in sketch:
        out[part] = np.frombuffer(zlib.decompress(counts), dtype=np.uint32)
    return out.ravel()


def short_lists(words: int, num: int, den: int, lengths, hot: int):
    """text -> shingle, class, size, place, hot: the lists that a class doesn't set aside, how many it puts before each.

    Each class comes once per task. hot: whether the list may have more than `hot` rows.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in source:
            lists, names, sizes = [np.zeros(0, np.uint64)], [], []
            for text in byte_texts(batch.column(0)):
                s = shingle_set(text, words)
                if len(s) == 0 or (name := class_name(s)) in seen:
                    continue
                seen.add(name)
                keep = len(s) - least_overlap(len(s), num, den) + occurrences(len(s), num, den)
                lists.append(s[np.lexsort((s, lengths.value[bucket(s)]))[:keep]])
                names.append(name)
                sizes.append(len(s))
            times = [len(x) for x in lists[1:]]
            places = np.concatenate([np.arange(n, dtype=np.int32) for n in [0, *times]])
            every = np.concatenate(lists)
            columns = [signed(every), np.repeat(np.array(names, np.int64), times), np.repeat(np.array(sizes, np.int32), times), places, lengths.value[bucket(every)] > hot]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["shingle", "class", "size", "place", "hot"])

    return run


def asked_sets(words: int, asked):
    """text, key -> class, shingles (as bytes), for the documents whose key is asked for."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in source:
            key = batch.column(1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((asked.value[key >> 3] >> (key & 7).astype(np.uint8)) & 1)
            names, sets = [], []
            for text in byte_texts(batch.column(0).take(pa.array(hit))):
                s = shingle_set(text, words)
                if len(s) and (name := class_name(s)) not in seen:
                    seen.add(name)
                    names.append(name)
                    sets.append(s.tobytes())
                if len(sets) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["class", "shingles"])
                    names, sets = [], []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["class", "shingles"])

    return run


def divide_skip(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that link, of different sides (or of any, where there is one side).

    Each set is searched for in the inverted lists of those before it.
    """
    size = np.array([len(s) for s in sets])
    if len(sets) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shingles, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(place, kind="stable")
    lists, starts = owner[order], np.r_[0, np.cumsum(np.bincount(place, minlength=len(shingles)))]
    at = np.r_[0, np.cumsum(size)]
    one_side = side.min() == side.max()
    left, right = [], []
    for q in range(1, len(sets)):
        own = place[at[q] : at[q + 1]]
        length = starts[own + 1] - starts[own]
        own, length = own[length > 1], length[length > 1]
        least = least_overlap(int(size[q]), num, den)
        if len(own) < least:
            continue
        long = min(least - 1, int(least / (MU * np.log2(max(2, length.max())) + 1)))
        own = own[np.argsort(length, kind="stable")]
        short, probed = own[: len(own) - long], own[len(own) - long :]
        merged = np.concatenate([lists[starts[w] : starts[w + 1]] for w in short])
        count = np.bincount(merged[merged < q], minlength=q)
        c = np.flatnonzero(count >= least - long)
        c = c[(den * np.minimum(size[c], size[q]) >= num * np.maximum(size[c], size[q])) & (one_side | (side[c] != side[q]))]
        if not len(c):
            continue
        shared = count[c]
        for w in probed:
            held = lists[starts[w] : starts[w + 1]]
            shared = shared + (held[np.minimum(np.searchsorted(held, c), len(held) - 1)] == c)
        c = c[den * shared >= num * (size[c] + size[q] - shared)]
        left.append(c)
        right.append(np.full(len(c), q))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def cell_links(num: int, den: int):
    """cell, class, block, copies, shingles, sorted by cell -> class, component (of the cell), links."""

    def linked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        first = {r[0]: r for r in rows}  # a set may come from several tasks
        if len(first) < 2:
            return None
        rows = sorted(first.values(), key=lambda r: (len(r[3]), r[0]))
        names, side, copies = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        a, b = divide_skip([np.frombuffer(r[3], np.uint64) for r in rows], side, num, den)
        if not len(a):
            return None
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = names[local_labels(len(rows), a, b)]
        return names[links > 0], root[links > 0], links[links > 0]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        names = ["class", "component", "links"]
        for batch in source:
            out = []
            for c, *row in zip(*(x.to_pylist() for x in batch.columns)):
                if c != cell:
                    out.append(linked(rows))
                    cell, rows = c, []
                rows.append(row)
            if out := [x for x in out if x]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)
        if last := linked(rows):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names)

    return run


def asked_bitmap(keys: DataFrame, n_bits: int) -> np.ndarray:
    """key (below 2**n_bits) -> its bits."""
    rows = keys.groupBy(F.bitmap_bucket_number(F.col("key") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("key") + 1)).alias("bits")).collect()
    out = np.zeros((1 << n_bits) // 8 + 4096, dtype=np.uint8)
    for b, bits in rows:
        start = (b - 1) * 4096
        out[start : start + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def met_lists(rows: DataFrame, num: int, den: int) -> DataFrame:
    """shingle, class, size, place, hot -> with part and length: lists of several classes, and hot ones as they are.

    A list is cut where the next larger class is too large to link with the one before it: then it is with all before.
    Rows of hot lists are dealt by class, so that none of them is gathered; their length isn't known yet.
    """
    rows = rows.withColumn("deal", F.when(F.col("hot"), F.col("class")).otherwise(0))
    by_size = Window.partitionBy("shingle", "deal").orderBy("size", "class")
    before = F.lag("size").over(by_size)
    cut = F.when(before.isNotNull() & (F.lit(den) * before >= F.lit(num) * F.col("size")), 0).otherwise(1)
    rows = rows.withColumn("cut", cut).withColumn("part", F.sum("cut").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("shingle", "deal", "part")
    rows = rows.select("shingle", "deal", "part", "class", "size", "place", "hot", F.count("*").over(own).alias("length"), F.min("class").over(own).alias("low"), F.max("class").over(own).alias("high"))
    return rows.where((F.col("low") < F.col("high")) | F.col("hot")).dropDuplicates(["shingle", "deal", "part", "class"]).drop("low", "high", "deal")


def merged_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """shingle, part, class, size, place of lists of up to FEW classes -> one, two: pairs of classes that may link.

    A pair must meet often enough, and can't share more than what follows its first meeting. Both rules look at the
    first shingles that a pair shares: if one of these is in a longer list, the pair is a candidate by that list, else
    all of them are counted here. Meetings after these may be in longer lists, in rows that linked_classes leaves out,
    so nothing is concluded from the last meeting.
    """
    members = lists.groupBy("shingle", "part").agg(F.array_sort(F.collect_list(F.struct("class", "size", "place"))).alias("m"))
    combined = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.lit(FEW)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = members.select(F.explode(combined).alias("p")).select(F.col("p.a.class").alias("one"), F.col("p.b.class").alias("two"), F.col("p.a.size").alias("s1"), F.col("p.b.size").alias("s2"), F.col("p.a.place").alias("p1"), F.col("p.b.place").alias("p2"))
    pairs = pairs.where(F.lit(den) * F.least("s1", "s2") >= F.lit(num) * F.greatest("s1", "s2"))
    met = pairs.groupBy("one", "two").agg(F.count("*").alias("n"), F.min("s1").alias("s1"), F.min("s2").alias("s2"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    enough = F.col("n") >= F.least(occurrences(F.col("s1"), num, den), occurrences(F.col("s2"), num, den))
    reach = F.least(F.col("s1") - F.col("p1"), F.col("s2") - F.col("p2"))
    return met.where(enough & (reach * (num + den) >= (F.col("s1") + F.col("s2")) * num)).select("one", "two")


def compared(num: int, den: int, lengths):
    """pivot, star, class, shingles, the pivot's own row before the classes it is compared with -> links and new lists.

    A row with `link` says that class and link are linked. Other rows post a class under a difference from its pivot
    (for star rows only): role 0 and 1, those linked with the pivot and those not, in lists where only the two meet
    each other, and role -1, those not linked with it, in lists where they meet among themselves.

    With d = |a ^ p|, e = |b ^ p| and D(x, y) the largest |x ^ y| of a link of such sizes, a and b share at least
    (d + e - D(a, b)) / 2 differences. Where b doesn't link with p, e > D(b, p), and D(b, p) - D(a, b) is at least
    k - 2 ceil(k num / (num + den)) for k = |p| - |a|. Where b does, it has at least as many differences as are shared,
    so that d - D(a, b) are.
    """

    def posted(a: np.ndarray, p: np.ndarray, held: np.ndarray, linked: bool, counts: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        lost = np.ones(len(p), bool)
        lost[np.searchsorted(p, a[held])] = False
        extra, lost = a[~held], p[lost]
        # What the pivot alone has is lost by all others: there, the most frequent shingle is the rarest difference.
        rank = np.r_[counts[bucket(extra)], counts[bucket(p)].max() - counts[bucket(lost)]]
        apart = np.r_[extra, lost]
        apart = apart[np.lexsort((apart, rank))]
        d, k = len(apart), len(p) - len(a)
        far = d - max(1, -(-(d + 1 + k - 2 * -(-num * k // (num + den))) // 2)) + 1
        largest = len(a) + len(a) * den // num
        if linked:
            yield apart[:far], 0, 1
        else:
            yield apart[: d - max(1, d - (den - num) * largest // (num + den)) + 1], 1, 1
            yield apart[:far], -1, 0

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = lengths.value.astype(np.int64)
        p, pivot = np.zeros(0, np.uint64), None
        names = ["list", "class", "size", "place", "role", "link"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        for batch in source:
            links, lists = [], [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32))]
            for name, star, own, held in zip(*(x.to_pylist() for x in batch.columns)):
                a = np.frombuffer(held, np.uint64)
                if own == name:
                    p, pivot = a, name
                    continue
                assert name == pivot
                held = p[np.minimum(np.searchsorted(p, a), len(p) - 1)] == a
                shared = int(held.sum())
                linked = den * shared >= num * (len(a) + len(p) - shared)
                if linked:
                    links.append((own, name))
                for tokens, role, side in posted(a, p, held, linked, counts) if star else ():
                    n = len(tokens)
                    group = np.full(n, np.int64(name)).view(np.uint64)
                    lists.append((mixed([group, tokens, np.full(n, side, np.uint64)]), np.full(n, own), np.full(n, len(a), np.int32), np.arange(n, dtype=np.int32), np.full(n, role, np.int32)))
            if links:
                u, v = (pa.array(x, pa.int64()) for x in zip(*links))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(u), kinds[0]), u, *(pa.nulls(len(u), k) for k in kinds[2:5]), v], names)
            lists = [np.concatenate(x) for x in zip(*lists)]
            yield pa.RecordBatch.from_arrays([signed(lists[0]), *(pa.array(x, k) for x, k in zip(lists[1:], kinds[1:])), pa.nulls(len(lists[0]), kinds[5])], names)

    return run


def met_again(lists: DataFrame) -> DataFrame:
    """list, class, size, place, role -> with n and pivot: the rows of lists in which classes meet."""
    told = lists.groupBy("list").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), F.min(F.struct("place", "class")).alias("pivot"), F.min("role").alias("role0"), F.max("role").alias("role1"))
    told = told.where((F.col("low") < F.col("high")) & ((F.col("role0") < 0) | (F.col("role0") < F.col("role1")))).select("list", "n", F.col("pivot.class").alias("pivot"))
    return lists.join(told, "list")


def candidates(met: DataFrame, longest: int, num: int, den: int) -> DataFrame:
    """Rows of met_again -> pivot, class, star: each class of a list of more than `longest` with its pivot, and the pairs
    of those of up to FEW."""
    star = met.where((F.col("n") > longest) & (F.col("pivot") != F.col("class"))).select("pivot", "class", F.lit(True).alias("star"))
    members = met.where(F.col("n") <= FEW).groupBy("list").agg(F.array_sort(F.collect_list(F.struct("class", "size", "role"))).alias("m"))
    pairs = members.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.lit(FEW)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    may = (F.col("p.a.class") < F.col("p.b.class")) & ((F.col("p.a.role") < 0) | (F.col("p.a.role") != F.col("p.b.role")))
    may &= F.lit(den) * F.least("p.a.size", "p.b.size") >= F.lit(num) * F.greatest("p.a.size", "p.b.size")
    return star.unionAll(pairs.where(may).select(F.col("p.a.class").alias("pivot"), F.col("p.b.class").alias("class"), F.lit(False)))


def compare(found: DataFrame, sets: DataFrame, num: int, den: int, lengths) -> DataFrame:
    """pivot, class, star (stored) -> the rows of `compared`. What a pivot meets is dealt to tasks by CHUNK."""
    often = found.groupBy("pivot").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = found.join(often, "pivot").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks"))).drop("chunks")
    members = dealt.join(sets, "class").select("pivot", "chunk", F.lit(1).alias("turn"), "star", "class", "shingles")
    heads = dealt.select("pivot", "chunk").distinct().join(sets, F.col("pivot") == F.col("class")).select("pivot", "chunk", F.lit(0), F.lit(False), "class", "shingles")
    rows = members.unionAll(heads).repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "turn")
    return rows.select("pivot", "star", "class", "shingles").mapInArrow(compared(num, den, lengths), "list long, class long, size int, place int, role int, link long")


def in_cells(longer: DataFrame, pairs: DataFrame, sets: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """list, class, length of long lists and pairs one, two -> class, component (of the cell), links, by cell."""
    longer = longer.select(F.col("list"), "class", "length")
    homes = longer.groupBy("class").agg(F.max(F.struct("length", "list")).alias("home"))
    chunk = F.pmod(F.xxhash64("class"), F.ceil(F.col("home.length") / BLOCK))
    homes = homes.select("class", F.xxhash64("home.list", chunk).alias("home"))
    ends = pairs.select(F.col("one").alias("class"), F.col("one").alias("by")).unionAll(pairs.select(F.col("two").alias("class"), F.col("one").alias("by")))
    blocks = ends.groupBy("class").agg(F.min("by").alias("by")).join(homes, "class", "full").select("class", F.coalesce("home", "by").alias("block"))
    key = F.xxhash64("one", "two", F.lit(1)).alias("list")
    meetings = longer.select("list", "class").unionAll(pairs.select(key, F.explode(F.array("one", "two")).alias("class")))
    members = stored(meetings.join(blocks, "class").select("list", "class", "block"), "blocks")
    met = members.select("list", F.col("block").alias("other")).distinct()
    cells = members.join(met, "list").select(F.xxhash64(F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "class", "block").distinct()
    return searched(stored(cells, "cells").join(classes.select("class", "copies"), "class"), sets, num, den)


def searched(cells: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """cell, class, block, copies -> class, component (of the cell), links."""
    full = cells.join(sets, "class").select("cell", "class", "block", "copies", "shingles")
    found = full.repartition("cell").sortWithinPartitions("cell").mapInArrow(cell_links(num, den), "class long, component long, links long")
    return stored(found, "cell_links")


class Lists(NamedTuple):
    """What the search starts from; all tables are stored."""

    rows: DataFrame  # doc_id, text_hash, n_shingles, class
    classes: DataFrame  # class, first_id, copies
    longer: DataFrame  # shingle, part, class, size, place, hot, length
    pairs: DataFrame  # one, two
    sets: DataFrame  # class, shingles
    lengths: Broadcast  # the sketch


def gathered(docs: DataFrame, words: int, num: int, den: int) -> Lists:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = texts.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = stored(hashed.mapInArrow(classes_and_sketch(words), "doc_id long, text_hash long, n_shingles long, class long, part int, counts binary"), "classes")
    own = rows.where(F.col("part").isNull()).select("doc_id", "text_hash", "n_shingles", "class")
    classes = own.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    sketch = list_lengths(rows)
    lengths, hot = spark.sparkContext.broadcast(sketch), max(HOT, int(HOT_MEANS * sketch.mean()))

    lists = texts.select("text").mapInArrow(short_lists(words, num, den, lengths, hot), "shingle long, class long, size int, place int, hot boolean")
    lists = stored(met_lists(lists, num, den), "short_lists")
    few = ~F.col("hot") & (F.col("length") <= FEW)
    pairs, longer = stored(merged_pairs(lists.where(few), num, den), "pairs"), lists.where(~few)
    met = longer.select("class").unionAll(pairs.select(F.explode(F.array("one", "two"))))
    wanted = stored(met.distinct().join(classes, "class"), "wanted")
    n_bits = bitmap_bits(wanted.count())
    key = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << n_bits)).alias("key")
    asked = spark.sparkContext.broadcast(asked_bitmap(wanted.select(key("first_id")), n_bits))
    held = texts.select("text", key("doc_id")).mapInArrow(asked_sets(words, asked), "class long, shingles binary")
    sets = stored(held.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"]), "sets")
    return Lists(own, classes, longer, pairs, sets, lengths)


def linked_classes(found: Lists, num: int, den: int) -> DataFrame:
    """class, component: the smallest class that links reach; classes without links have no row."""
    # Partners are in one band of sizes or in neighbours; every list of two neighbours has its own pivot.
    band = F.floor(F.log("size") / (math.log(den / num) * 1.000001 if num < den else 1e-9)).cast("long")
    longer = found.longer.select(F.explode(F.array(band, band - 1)).alias("band"), "shingle", "class", "size", "place")
    lists = longer.select(F.xxhash64("shingle", "band").alias("list"), "class", "size", "place", F.lit(-1).alias("role"))
    least = lists.groupBy("list").agg(F.min("size").alias("least"))
    partner = F.greatest("least", F.ceil(F.lit(num) * F.col("size") / den))
    need = F.ceil(F.lit(num) * (F.col("size") + partner) / (num + den))
    lists = lists.join(least, "list").where(F.col("place") < F.col("size") - need + occurrences(F.col("size"), num, den)).drop("least")
    pairs = found.pairs.select(F.col("one").alias("pivot"), F.col("two").alias("class"), F.lit(False).alias("star"))
    edges = lambda rows: rows.select(F.col("class").alias("u"), F.col("component").alias("v"))
    links = None
    for level in range(LEVELS + 1):
        met = stored(met_again(lists), "met")
        if level and met.isEmpty():
            break
        if level == LEVELS:
            new = edges(in_cells(met.select("list", "class", F.col("n").alias("length")), found.pairs.where(F.lit(False)), found.sets, found.classes, num, den))
        else:
            asked = candidates(met, GROUP if level else FEW, num, den)
            asked = stored((asked if level else asked.unionAll(pairs)).groupBy("pivot", "class").agg(F.max("star").alias("star")), "candidates")
            told = stored(compare(asked, found.sets, num, den, found.lengths), "compared")
            lists, new = told.where(F.col("list").isNotNull()).drop("link"), told.where(F.col("link").isNotNull()).select(F.col("class").alias("u"), F.col("link").alias("v"))
            if level:
                some = met.where((F.col("n") > FEW) & (F.col("n") <= GROUP)).select(F.col("list").alias("cell"), "class", F.col("role").alias("block"), F.lit(1).cast("long").alias("copies"))
                new = new.unionAll(edges(searched(some, found.sets, num, den)))
        links = links.unionAll(new) if links else new
    return components(links).select(F.col("node").alias("class"), "component")


def join_ngrams(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """doc_id, text -> doc_id, text_hash, n_shingles, class, component, component_id.

    Documents link when den * intersection >= num * union. class names the set of shingles, component the classes that
    links reach (both null without words), component_id is the smallest doc_id that links reach.
    """
    found = gathered(docs, words, num, den)
    named = found.classes.join(linked_classes(found, num, den), "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stored(named.join(ids, "component").select("class", "component", "component_id"), "named")
    return found.rows.join(named, "class", "left").select("doc_id", "text_hash", "n_shingles", "class", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def count_links(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """doc_id, text -> doc_id, n_links: the other documents, equal ones included, that each one links with.

    A count needs every pair that may link: of L classes in one list, L * L / BLOCK rows are dealt to cells. So this is
    for corpora without large groups of near copies (or after keep_first); components need no such work.
    """
    found = gathered(docs, words, num, den)
    longer = found.longer.select(F.xxhash64("shingle", F.when(~F.col("hot"), F.col("part"))).alias("list"), "class")
    longer = longer.join(longer.groupBy("list").agg(F.count("*").alias("length")), "list")
    links = in_cells(longer, found.pairs, found.sets, found.classes, num, den).groupBy("class").agg(F.sum("links").alias("links"))
    named = found.classes.join(links, "class", "left").select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return found.rows.join(named, "class", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_first(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """One row of docs for each component, all columns: that of the smallest doc_id (null last), then text hash.

    Documents without words are each a component of their own. Of rows that repeat both doc_id and text one stays; rows
    of one doc_id and different texts that don't link both stay.
    """
    found = join_ngrams(docs, words, num, den)
    alone = F.xxhash64("doc_id", "text_hash", F.lit("alone"))
    kept = found.groupBy(F.col("component").isNull().alias("wordless"), F.coalesce("component", alone).alias("component")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("_kept_id"), F.col("k.text_hash").alias("_kept_hash"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_hash") == F.col("_kept_hash"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["_id", "_hash"]).select("_row.*")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join_ngrams(table(spark, sf_dir, "documents"), 4, 85, 100).select("doc_id", "n_shingles", "component_id")
