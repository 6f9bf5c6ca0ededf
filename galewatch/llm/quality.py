"""Quality rules with a suffix array over the words of each document.

The base rules count words, symbols, equal lines and repeated three-word windows. The verdict comes from the suffix
array: prefix doubling ranks the suffixes, longest common prefixes of neighbours give the maximal repeated substrings
of at least MIN_REPEAT words, their spans are united, and both the covered share of the words and the longest repeat
are limited. Each covered word is in a repeated three-word window too, so the limits are far below MAX_REPEAT_SHARE: a
higher one would let through just what the base rules do. Neither limit follows from the other: many short passages
exceed the first, one passage that stands twice the second. Suffix arrays are built for all documents of a chunk at once; suffixes never match across documents. A
chunk is a megabyte of text, or one longer text; ranks take 8 bytes for each of its words and each doubling, so 8 n
(2 + log2 of the longest repeat) bytes for n words: 200 MB for a text of a million times one word.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; repeated rows are judged each
for itself; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewatch.llm.common import table
from galewatch.llm.wordarrays import byte_texts, chunks, word_hashes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_SHARE = 50, 50  # base rules: words at least; percent of words in repeated windows at most
MIN_REPEAT = 8  # words from which a repeated substring counts
MAX_COVERED, MAX_LONGEST = 0.12, 0.05  # share of the words under repeats; share of the longest repeat
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True
IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(SYMBOLS)] = True


def refined(rank: np.ndarray, active: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split the groups of equal rank by `second`; ranks are places in the suffix order, so the rest stays as it is.

    Returns the new ranks and the positions that still share theirs.
    """
    order = np.lexsort((second, rank[active]))
    at, r, q = active[order], rank[active][order], second[order]
    i = np.arange(len(at))
    old = np.r_[True, r[1:] != r[:-1]]
    new = old | np.r_[True, q[1:] != q[:-1]]
    old_start, new_start = np.maximum.accumulate(np.where(old, i, 0)), np.maximum.accumulate(np.where(new, i, 0))
    out = rank.copy()
    out[at] = r + new_start - old_start
    alone = new & np.r_[new[1:], True]
    return out, at[~alone]


def repeats(words: np.ndarray, doc: np.ndarray, least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word is in a 3-word window that repeats in its document, and the words of the longest repeat of at
    least `least` words that starts at it (else 0).

    words: a key for each word; doc: its document, ascending.
    """
    n = len(words)
    window, longest = np.zeros(n + 2, dtype=bool), np.zeros(n, dtype=np.int64)
    if n == 0:
        return window[:0], longest
    ends = np.searchsorted(doc, doc, side="right")

    def ahead(rank: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        return np.where(at + k < ends[at], rank[np.minimum(at + k, n - 1)], -1)

    # levels[k] ranks suffixes by their first 2**k words; equal ranks mean that these words are equal and complete.
    everything = np.arange(n)
    word = np.unique(words, return_inverse=True)[1]
    rank, active = refined(np.searchsorted(doc, doc), everything, word)
    levels, shared = [rank], [active]
    while len(active):
        h = 1 << (len(levels) - 1)
        if h == 2:  # windows of three: equal pairs with an equal next word
            third, same = refined(rank, active, ahead(levels[0], active, 2))
            same = same[same + 2 < ends[same]]
            for k in range(3):
                window[same + k] = True
        rank, active = refined(rank, active, ahead(rank, active, h))
        levels.append(rank)
        shared.append(active)

    start = max(k for k in range(len(levels)) if 1 << k <= least)
    suffixes = shared[start][np.argsort(rank[shared[start]])]  # the part of the suffix array that can repeat
    if len(suffixes) > 1:
        a, b = suffixes[:-1], suffixes[1:]
        lcp = np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + lcp, b + lcp
            inside = (x < ends[a]) & (y < ends[b]) & (doc[a] == doc[b])
            lcp += np.where(inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]), 1 << k, 0)
        best = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
        longest[suffixes] = np.where(best >= least, best, 0)
    return window[:n], longest


def starts_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between the starts (the last one ends the last), for empty pieces too."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[starts[1:]] - total[starts[:-1]]


def judged(texts: list[bytes]) -> list[np.ndarray]:
    """The columns of SCHEMA after doc_id, for the texts of one chunk."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    chars = starts_sum(((raw & 0xC0) != 0x80) & ~IS_SPACE[raw], at)
    symbols = starts_sum(IS_SYMBOL[raw], at)
    hashes = [word_hashes(t) for t in texts]
    n_words = np.array([len(h) for h in hashes], dtype=np.int64)
    lines = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            own = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            lines[i] = len(own) - len(set(own))
    doc = np.repeat(np.arange(len(texts)), n_words)
    window, longest = repeats(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), doc)
    places = np.r_[0, np.cumsum(n_words)]
    spans = np.zeros(len(doc) + 1, dtype=np.int64)  # the union of the repeats' spans
    np.add.at(spans, np.flatnonzero(longest), 1)
    np.add.at(spans, np.flatnonzero(longest) + longest[longest > 0], -1)
    covered = starts_sum(np.cumsum(spans[:-1]) > 0, places)
    most = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(most, doc, longest)
    repeated = starts_sum(window, places)
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_SHARE * n_words)
    kept = ~failed & (covered <= MAX_COVERED * n_words) & (most <= MAX_LONGEST * n_words)
    return [n_words, chars, symbols, lines, repeated, covered, most, failed, kept]


def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in source:
        texts, ids = byte_texts(batch.column(1)), batch.column(0)
        for a, b in chunks(texts):
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *map(pa.array, judged(texts[a:b]))], names)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, text -> the columns of SCHEMA, a row for each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text the rules keep, all columns."""
    schema = docs.schema
    place = docs.columns.index("text")

    def kept(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = byte_texts(batch.column(place))
            for a, b in chunks(texts):
                yield batch.slice(a, b - a).filter(pa.array(judged(texts[a:b])[-1]))

    return docs.mapInArrow(kept, schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
