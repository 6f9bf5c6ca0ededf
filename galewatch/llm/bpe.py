"""Byte-level BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

Merges are applied in the order of their ranks. What follows a prefix can change the prefix's tokens only near its end.
Let two texts share a prefix, and let b be the end of their last common token boundary inside it. A merge (x, y) moves b
only if x ends at b and, in one of the texts, y follows: then b moves left by x. The token after b in that text starts
with the left part of the merge that moved b before, so that this part is on the left edge of y, and ranks rise along
the way. The longest such chain of merges, weighted by the lengths of their left parts, is a lookahead that is enough
for any text (320 bytes for the public 50k merges); one pass over the merge list finds it.

The transducer holds a window of bytes. Tokens that end at least the lookahead before the window's end are stable: they
are emitted and their bytes dropped, and as no merge crosses a token boundary the rest goes on by itself. At the end of
a pre-token everything is stable, so most pre-tokens need a single, short window; one of many megabytes needs no more
memory than the window. Short windows of different pre-tokens are merged side by side, as rows of a matrix. Tokens of
pre-tokens are remembered, up to a fixed number.

Texts are cut at special tokens and read in pieces that end where a word meets a blank, which every pre-token ends at.
Where pre-tokens begin depends on the classes of neighbouring characters only, so all pieces of a slice of rows are cut
at once; a piece that is long because it has no blanks is read by the pattern. Letters and numbers are those of Unicode
16, whatever tables the installed regex module has.

Decoding joins the tokens' bytes and feeds them to a state machine that gives text as soon as characters are whole; an
invalid sequence becomes U+FFFD.

Defined cases: a null text is an empty one and has no tokens; null ids decode to an empty text, and ids that the
vocabulary lacks are left out; repeated rows are rows of their own; an empty table gives an empty result; columns other
than doc_id and text (or ids) are ignored, whatever their names. Tokenizer files must be byte-level BPE without
normalizer, added prefix space, dropout or affixes, and no larger than MOST_FILE; other files are refused.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewatch.llm.common import table

#: Bytes of a window beyond the lookahead; characters of a piece of text; pre-tokens that are remembered, and the bytes
#: of all of them; ids that are decoded, or pre-tokens of a blank-free text that are looked up, at once; bytes of a slice
#: of rows, and of a tokenizer file.
STEP, PIECE, REMEMBERED, MOST_BYTES, BATCH, SLICE, MOST_FILE = 2048, 1 << 16, 1 << 18, 1 << 23, 1 << 16, 1 << 21, 1 << 26
#: Pre-tokens of up to so many bytes are merged side by side with those of like length, if there are FEW at least.
WIDTHS, FEW = (4, 6, 8, 10, 12, 16, 24, 32, 48, 64), 32
#: Classes of characters.
OTHER, LETTER, NUMBER, BLANK, SPECIAL = range(5)
#: What may stand before a pre-token of letters or numbers, and the contractions that are pre-tokens: fixed values.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
#: Code points that became letters or numbers in Unicode 16, as ranges: fixed values.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


def as_ranges(points: list[int]) -> str:
    """Ascending code points -> the inside of a character class."""
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def patterns() -> tuple[str, str, str, bytes]:
    """The pre-tokens' pattern with the regex module's own classes, the same with those of Unicode 16, the class of
    characters for which the two differ, and each code point's class by Unicode 16."""
    points = [p for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000]
    odd, classes, table = set(), {}, np.full(sys.maxunicode + 1, OTHER, np.uint8)
    everything = "".join(map(chr, points))
    table[[*map(ord, regex.findall(r"\s", everything))]] = BLANK
    for kind, added, number in (("L", LETTERS_16, LETTER), ("N", NUMBERS_16, NUMBER)):
        newer = {p for a, b in added for p in range(a, b + 1)}
        wanted = [p for p in points if unicodedata.category(chr(p))[0] == kind or p in newer]
        classes[kind] = as_ranges(wanted)
        table[wanted] = number
        own = regex.findall(rf"\p{{{kind}}}", everything)
        odd |= set(wanted) ^ set(map(ord, own))
    filled = lambda letters, numbers: PRETOKENS.replace("{L}", letters).replace("{N}", numbers)
    return filled(r"\p{L}", r"\p{N}"), filled(classes["L"], classes["N"]), f"[{as_ranges(sorted(odd)) or '^\\s\\S'}]", table.tobytes()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is visible, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def enough_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that settle it, whatever follows them: the longest chain of merges (see above)."""
    reached: dict[bytes, int] = {}  # a left part -> the longest chain that ends in a merge with it
    edge: dict[bytes, list[bytes]] = {}  # a token -> the tokens on its left edge, itself included
    longest = 0
    for x, y in merges:
        total = len(x) + max(reached.get(t, 0) for t in edge.get(y, [y]))
        reached[x] = max(total, reached.get(x, 0))
        longest = max(longest, total)
        edge.setdefault(x + y, [*edge.get(x, [x]), x + y])
    return longest


class Tokens(dict):
    """id -> bytes; ids that the vocabulary lacks have none."""

    def __missing__(self, key: int) -> bytes:
        return b""


class Remembered:
    """Pre-tokens -> places in one array of their tokens, in the order in which they came."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.bytes, self.ids, self.ends = 0, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, words: list[str], n_bytes: int, ids: np.ndarray, counts: np.ndarray) -> None:
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(words))))
        self.bytes += n_bytes
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])


class Vocabulary(NamedTuple):
    """What the transducer reads; made once per Python worker."""

    ranks: dict[int, int]  # left id * size + right id -> rank
    pairs: np.ndarray  # the keys of ranks, ascending, and one that is above all
    pair_ranks: np.ndarray  # their ranks; the last is the number of merges
    merged: np.ndarray  # rank -> id
    size: int
    first: np.ndarray  # byte -> id
    byte_ranks: np.ndarray  # two bytes -> the rank of their merge, or the number of merges
    tokens: Tokens
    spelt: pa.BinaryArray  # id -> bytes; the last is empty and stands for ids that the vocabulary lacks
    specials: dict[str, int]
    lookahead: int
    longest: int  # bytes of the longest token
    fast: regex.Pattern
    exact: regex.Pattern
    odd: re.Pattern
    classes: np.ndarray  # code point -> class
    remembered: list[Remembered]  # one


def read_vocabulary(source: bytes, texts: tuple[str, str, str, bytes]) -> Vocabulary:
    file = json.loads(source)
    model, pre = file["model"], file["pre_tokenizer"] or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or file.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("not a byte-level BPE file of the kind that is read here")
    if any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("special tokens with options are not read here")
    letters = byte_letters()
    known = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in {a["content"] for a in file["added_tokens"]}}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = [(bytes(letters[c] for c in x), bytes(letters[c] for c in y)) for x, y in pairs]
    specials = {t["content"]: t["id"] for t in file["added_tokens"]}
    tokens = Tokens({i: t for t, i in known.items()} | {i: t.encode() for t, i in specials.items()})
    size = max(tokens) + 1
    ranks = {known[x] * size + known[y]: r for r, (x, y) in enumerate(merges)}
    first = [known[bytes([b])] for b in range(256)]
    byte_ranks = [ranks.get(x * size + y, len(merges)) for x in first for y in first]
    keys = sorted(ranks)
    return Vocabulary(
        ranks, np.array([*keys, np.iinfo(np.int64).max]), np.array([*map(ranks.get, keys), len(merges)], np.int32), np.array([known[x + y] for x, y in merges], np.int32), size,
        np.array(first, np.int32), np.array(byte_ranks, np.int32), tokens, pa.array([*map(tokens.__getitem__, range(size)), b""], pa.binary()), specials, enough_lookahead(merges),
        max(map(len, tokens.values())), regex.compile(texts[0]), regex.compile(texts[1]), re.compile(texts[2]), np.frombuffer(texts[3], np.uint8), [Remembered()],
    )


def ranks_of(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The ranks of pairs of ids, or the number of merges where there is none."""
    keys = left.astype(np.int64) * v.size + right
    at = np.searchsorted(v.pairs, keys)
    return np.where(v.pairs[at] == keys, v.pair_ranks[at], np.int32(len(v.merged)))


def side_by_side(data: np.ndarray, lengths: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All merges of short windows, the rows of a matrix of bytes -> their ids, to the left, and how many there are. A
    round does the lowest-ranked merge of each row that has one, at its first place, so these rows lose one id each."""
    none, n, width = len(v.merged), *data.shape
    out, counts, rows = np.zeros((n, width), np.int32), lengths.copy(), np.arange(n)
    ids, columns = v.first[data], np.arange(width)
    ranks = np.full((n, width), none, np.int32)  # of an id and the next one
    ranks[:, :-1] = v.byte_ranks[data[:, :-1].astype(np.int32) << 8 | data[:, 1:]]
    ranks[columns >= lengths[:, None] - 1] = none
    while True:
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(rows)), at]
        left = best < none
        if not left.all():
            out[rows[~left], : ids.shape[1]] = ids[~left]
            rows, ids, ranks, at, best = rows[left], ids[left], ranks[left], at[left], best[left]
        if not len(rows):
            return out, counts
        counts[rows] -= 1
        row, beyond = np.arange(len(rows)), columns[: ids.shape[1] - 1] >= at[:, None]
        ids, ranks = np.where(beyond, ids[:, 1:], ids[:, :-1]), np.where(beyond, ranks[:, 1:], ranks[:, :-1])
        ids[row, at] = new = v.merged[best]
        inner = np.flatnonzero(at)
        ranks[inner, at[inner] - 1] = ranks_of(ids[inner, at[inner] - 1], new[inner], v)
        inner = np.flatnonzero(at + 1 < counts[rows])
        ranks[inner, at[inner]] = ranks_of(new[inner], ids[inner, at[inner] + 1], v)


def heaped(data: bytes, v: Vocabulary) -> list[int]:
    """All merges of a longer window: pairs wait in a heap by rank and place."""
    ids = v.first[np.frombuffer(data, np.uint8)].tolist()
    ranks, merged, size, n = v.ranks, v.merged, v.size, len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[k], i, k) for i in range(n - 1) if (k := ids[i] * size + ids[i + 1]) in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i, key = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or ids[i] * size + ids[j] != key:  # one of the two was merged meanwhile
            continue
        ids[i], ids[j], k = int(merged[rank]), -1, after[j]
        after[i] = k
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n and (key := ids[a] * size + ids[b]) in ranks:
                heapq.heappush(heap, (ranks[key], a, key))
    return [t for t in ids if t >= 0]


class Transducer:
    """Bytes of one pre-token in, tokens out as soon as nothing that follows can change them."""

    def __init__(self, v: Vocabulary, step: int = STEP):
        self.v, self.held, self.window = v, bytearray(), v.lookahead + max(step, v.longest)

    def _merged(self, n: int) -> list[int]:
        return heaped(bytes(self.held[:n]), self.v)

    def feed(self, data: bytes) -> Iterator[int]:
        """Never holds more than a window and the bytes that are fed at once."""
        self.held += data
        while len(self.held) > self.window:
            stable, end = self.window - self.v.lookahead, 0
            for t in self._merged(self.window):
                if end + len(self.v.tokens[t]) > stable:
                    break
                end += len(self.v.tokens[t])
                yield t
            del self.held[:end]

    def close(self) -> Iterator[int]:
        yield from self._merged(len(self.held))
        self.held.clear()


def pretoken_ids(data: bytes, v: Vocabulary) -> np.ndarray:
    machine = Transducer(v)
    fed = (machine.feed(data[i : i + PIECE]) for i in range(0, len(data), PIECE))
    return np.fromiter(chain(chain.from_iterable(fed), machine.close()), np.int32)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places start, start + 1 and so on, count of them, for each start in turn."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def fresh_ids(words: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens -> their ids, one after another, and how many each has."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, lengths = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(offsets)
    groups, lower, counts = [], 0, np.zeros(len(words), np.int64)
    for upper in (*WIDTHS, None):
        rows = np.flatnonzero((lengths > lower) & ((lengths <= upper) if upper else True))
        if upper and len(rows) >= FEW:
            bytes_ = data[np.minimum(offsets[rows][:, None] + np.arange(upper), len(data) - 1)]
            ids, counts[rows] = side_by_side(bytes_, lengths[rows], v)
            groups.append((rows, ids[np.arange(upper) < counts[rows][:, None]]))
        elif len(rows):
            ids = [pretoken_ids(data[offsets[i] : offsets[i + 1]].tobytes(), v) for i in rows]
            counts[rows] = [*map(len, ids)]
            groups.append((rows, np.concatenate(ids)))
        lower = upper
    out, starts = np.zeros(counts.sum(), np.int32), np.cumsum(counts) - counts
    for rows, ids in groups:
        out[spread(starts[rows], counts[rows])] = ids
    return out, counts


def word_ids(words: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens and special tokens -> their ids, one after another, and how many each has; each different one is looked up once."""
    coded = words.dictionary_encode()
    known = v.remembered[0]
    if len(known.places) >= REMEMBERED or known.bytes >= MOST_BYTES:
        known = v.remembered[0] = Remembered()
    if not known.places:
        known.add([*v.specials], 0, np.array([*v.specials.values()], np.int32), np.ones(len(v.specials), np.int64))
    texts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
    places = np.fromiter(map(known.places.get, texts, repeat(-1)), np.int64, len(texts))
    if len(new := np.flatnonzero(places < 0)):
        places[new] = np.arange(len(known.places), len(known.places) + len(new))
        chosen = coded.dictionary.take(pa.array(new))
        known.add([texts[i] for i in new], pc.sum(pc.binary_length(chosen)).as_py(), *fresh_ids(chosen, v))
    places = places[coded.indices.to_numpy()]
    counts = known.ends[places + 1] - known.ends[places]
    return known.ids[spread(known.ends[places], counts)], counts


def pretokens(piece: str, v: Vocabulary) -> Iterator[list[str]]:
    """The pre-tokens of a piece, in lists."""
    try:
        piece.encode("latin-1")  # no such character is odd; this is by far the fastest way to tell
        pattern = v.fast
    except UnicodeEncodeError:
        pattern = v.exact if v.odd.search(piece) else v.fast
    if len(piece) <= 2 * PIECE:
        yield pattern.findall(piece)
        return
    words = pattern.finditer(piece)
    while some := [w.group() for w in islice(words, BATCH)]:
        yield some


def beginnings(points: np.ndarray, cuts: np.ndarray, special: list[tuple[int, int]], v: Vocabulary) -> np.ndarray:
    """Where pre-tokens begin, as the pattern has it, in pieces that follow one another. points: code points; cuts: where
    pieces begin; special: the ranges of special tokens, which are pieces of their own."""
    kind = v.classes[points]
    for a, b in special:
        kind[a:b] = SPECIAL
    begins, cut = np.ones(len(points) + 3, bool), np.zeros(len(points) + 3, bool)
    cut[cuts] = cut[len(points) :] = True
    begins[1 : len(points)] = kind[1:] != kind[:-1]
    begins[cuts] = True
    blank = kind == BLANK
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~cut[1 : len(points)])  # of white space before something else
    begins[last] = True
    begins[last[points[last] == 0x20] + 1] = False
    marks = np.flatnonzero(points == 0x27)
    marks = marks[begins[marks] & ~cut[marks + 1]]
    one = points[marks + 1]
    two = np.where(cut[marks + 2], 0, points[np.minimum(marks + 2, len(points) - 1)])
    is_ = lambda of, letters: np.isin(of, [*map(ord, letters)])
    for n, found in ((1, is_(one, "stmd")), (2, (is_(one, "rv") & is_(two, "e")) | (is_(one, "l") & is_(two, "l")))):
        begins[marks[found] + 1] = False
        begins[marks[found] + 1 + n] = True
    return np.flatnonzero(begins[: len(points)])


#: A piece may end before a blank that follows a word: whatever counts as white space, a pre-token ends there.
PIECE_END = re.compile(r"(?<=\S)[ \n]")


def cut_up(text: str, special: re.Pattern) -> Iterator[tuple[str, bool]]:
    """The pieces of a text, and whether they are special tokens."""
    start = 0
    for m in chain(special.finditer(text), [None]):
        end, rest = m.start() if m else len(text), start
        while rest < end:
            cut = PIECE_END.search(text, rest + PIECE, end) if end - rest > PIECE else None
            stop = cut.start() if cut else end
            yield text[rest:stop], False
            rest = stop
        if m:
            yield m.group(), True
            start = m.end()


def pieces_ids(parts: list[tuple[str, bool]], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces, one after another, and how many each has."""
    whole = "".join(p for p, _ in parts)
    points, data = np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.frombuffer(whole.encode(), np.uint8)
    ends = np.cumsum([len(p) for p, _ in parts])
    starts = beginnings(points, np.append(0, ends[:-1]), [(e - len(p), e) for (p, s), e in zip(parts, ends) if s], v)
    at = starts if len(data) == len(points) else np.flatnonzero((data & 0xC0) != 0x80)[starts]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))
    ids, counts = word_ids(words, v)
    return ids, np.diff(np.append(0, np.cumsum(counts)[np.searchsorted(starts, ends) - 1]))


def encoded_rows(texts: list[str], v: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The tokens of texts, in runs: rows, how many ids of the run each has, and the ids."""
    special = re.compile("|".join(f"({re.escape(t)})" for t in sorted(v.specials, key=len, reverse=True)) or r"(?!)")
    held, rows, size = [], [], 0

    def run():
        ids, counts = pieces_ids(held, v)
        return np.array(rows), counts, ids

    for row, text in enumerate(texts):
        for part in cut_up(text, special):
            if held and size + len(part[0]) > SLICE:
                yield run()
                held, rows, size = [], [], 0
            if len(part[0]) <= 2 * PIECE:
                held.append(part)
                rows.append(row)
                size += len(part[0])
                continue
            if held:
                yield run()
                held, rows, size = [], [], 0
            for some in pretokens(part[0], v):
                ids, counts = word_ids(pa.array(some, pa.string()), v)
                yield np.array([row]), np.array([len(ids)]), ids
    if held:
        yield run()


def encoded(text: str, v: Vocabulary) -> Iterator[list[int]]:
    """The tokens of a text, in runs."""
    for _, _, ids in encoded_rows([text], v):
        yield ids.tolist()


def encoded_lists(texts: list[str], v: Vocabulary) -> pa.ListArray:
    """The tokens of texts, as an array of lists."""
    total, runs = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
    for rows, counts, ids in encoded_rows(texts, v):
        np.add.at(total, rows, counts)
        runs.append(ids)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(total)), pa.int32()), pa.array(np.concatenate(runs), pa.int32()))


def joined(ids: np.ndarray, v: Vocabulary) -> tuple[bytes, np.ndarray]:
    """The bytes of tokens, end to end, and where each one begins and the last one ends."""
    taken = v.spelt.take(pa.array(np.where((ids >= 0) & (ids < v.size), ids, v.size)))
    ends = np.frombuffer(taken.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    return (taken.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[: ends[-1]], ends


class TextDecoder:
    """Token ids in, text out as soon as its characters are whole; at most three bytes wait."""

    def __init__(self, v: Vocabulary):
        self.v, self.machine = v, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int] | np.ndarray) -> str:
        return self.machine.decode(joined(np.asarray(ids, np.int64), self.v)[0])

    def close(self) -> str:
        return self.machine.decode(b"", True)


def shared_vocabulary(spark, path: str) -> Broadcast:
    """The tokenizer file, read by the driver and sent to the workers; its size is checked."""
    with open(path, "rb") as f:
        source = f.read(MOST_FILE + 1)
    if len(source) > MOST_FILE:
        raise ValueError(f"{path} is larger than {MOST_FILE} bytes")
    texts = patterns()
    read_vocabulary(source, texts)  # a file that can't be read fails here, not in a task
    return spark.sparkContext.broadcast({"file": source, "patterns": texts})


def vocabulary(sent: Broadcast) -> Vocabulary:
    """The vocabulary of this worker; it stays with the broadcast value, for all tasks of the worker."""
    held = sent.value
    if "read" not in held:
        held["read"] = read_vocabulary(held["file"], held["patterns"])
    return held["read"]


def decoded(ids: np.ndarray, v: Vocabulary) -> str:
    machine = TextDecoder(v)
    return "".join([*(machine.feed(ids[i : i + BATCH]) for i in range(0, len(ids), BATCH)), machine.close()])


def decoded_rows(ids: np.ndarray, ends: np.ndarray, v: Vocabulary) -> list[str]:
    """The texts of rows of ids; row i has those from ends[i] to ends[i + 1]. The bytes of up to BATCH ids are joined at once."""
    out: list[str] = []
    machine = TextDecoder(v).machine
    for a, b in slices(np.diff(ends), BATCH):
        if b == a + 1:
            out.append(decoded(ids[ends[a] : ends[b]], v))
            continue
        data, at = joined(ids[ends[a] : ends[b]], v)
        at = at[ends[a : b + 1] - ends[a]].tolist()
        out += [machine.decode(data[i:j], True) for i, j in zip(at, at[1:])]
    return out


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Rows from and to, of about `limit` in all; a large row comes alone."""
    upto, start = np.cumsum(sizes.astype(np.int64)), 0
    while start < len(upto):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + limit, "right")))
        yield start, end
        start = end


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of doc_id, text in slices of about SLICE bytes; a long text comes alone."""
    for start, end in slices(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), SLICE):
        yield batch.slice(start, end - start)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text -> doc_id, ids (array<int>): the tokens of each text by the tokenizer file at path."""
    sent = shared_vocabulary(docs.sparkSession, path)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(sent)
        for batch in source:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), encoded_lists(part.column(1).to_pylist(), v)], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids -> doc_id, ids, text."""
    sent = shared_vocabulary(rows.sparkSession, path)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(sent)
        for batch in source:
            ids, ends = batch.column(1).values.fill_null(-1).to_numpy(), batch.column(1).offsets.to_numpy()
            for i, j in slices(np.diff(ends), SLICE):
                part, texts = batch.slice(i, j - i), decoded_rows(ids, ends[i : j + 1], v)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    read = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return read.mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text -> doc_id, ids, text: encode and decode in one pass. The text is what the ids decode to."""
    sent = shared_vocabulary(docs.sparkSession, path)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(sent)
        for batch in source:
            for part in pieces(batch):
                lists = encoded_lists(part.column(1).to_pylist(), v)
                texts = decoded_rows(lists.values.to_numpy(), lists.offsets.to_numpy(), v)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, text string")


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    both = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
