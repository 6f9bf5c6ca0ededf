"""Byte-level BPE against the tokenizers library, round trips and constant memory."""

import hashlib
import random
import time

import public_tokenizers
import pytest
from conftest import SMALL
from tokenizers import Tokenizer

from galewatch.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Letters of several scripts, white space of all kinds, letters and numbers of Unicode 15 to 17, special tokens and parts of them.
ALPHABET = ["a", "b", "e", "t", "h", " ", "  ", "\n", "\t", "1", "23", "'s", "'ll", "é", "ß", "日本", "՘", " ", "\x1c", "\x85", "\xa0", "😀", "<|endoftext|>", "<|endoftext", "-", "=", "!", "_"] + [
    "\U0002ebf0", "\U00031350", "౜", "Ᲊ", "À", "Ã", "Â", "the", " the", "́", "٣", "Ⅷ", "\U0001f468‍", "\x00",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.read_vocabulary(f.read(), bpe.patterns())


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def ids_of(text, v):
    return [i for run in bpe.encoded(text, v) for i in run]


def test_encoding_equals_library(library, vocabulary):
    for text in texts(1, 3000):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(text, vocabulary) == want
        machine = bpe.TextDecoder(vocabulary)
        assert machine.feed(want) + machine.close() == library.decode(want, skip_special_tokens=False)


def test_lookahead_is_enough_at_every_cut(library, vocabulary):
    """Whatever the window, a token is emitted only if no later byte can change it."""
    rng = random.Random(2)
    assert vocabulary.lookahead == 320
    runs = ["a" * 3000, "ab" * 1500, "ÃÂ" * 1200, "".join(rng.choice("ÃÂ") for _ in range(2000)), "".join(rng.choice("abcdetaoinshr") for _ in range(4000)), "0123456789" * 300, "-=" * 900]
    for text in runs:
        assert len(vocabulary.fast.findall(text)) == 1
        want, data = library.encode(text, add_special_tokens=False).ids, text.encode()
        for step, fed in ((1, 7), (300, 5000)):
            machine = bpe.Transducer(vocabulary, step)
            got = [t for i in range(0, len(data), fed) for t in machine.feed(data[i : i + fed])]
            assert len(machine.held) <= machine.window and got == want[: len(got)]
            assert got + list(machine.close()) == want


def test_lookahead_of_small_merge_lists():
    """By brute force: tokens of every prefix that end as far before its end as the lookahead says stay in every continuation."""
    rng = random.Random(3)
    for _ in range(40):
        tokens, merges = [b"a", b"b"], []
        while len(merges) < 6:
            x, y = rng.choice(tokens), rng.choice(tokens)
            if x + y not in tokens and len(x + y) < 9:
                tokens.append(x + y)
                merges.append((x, y))

        def tokenized(data):
            parts = [bytes([b]) for b in data]
            for x, y in merges:
                i = 0
                while i + 1 < len(parts):
                    if (parts[i], parts[i + 1]) == (x, y):
                        parts[i : i + 2] = [x + y]
                    i += 1
            ends, at = [], 0
            for p in parts:
                at += len(p)
                ends.append(at)
            return ends

        enough = bpe.enough_lookahead(merges)
        for _ in range(60):
            data = bytes(rng.choice(b"ab") for _ in range(40))
            whole = tokenized(data)
            for n in range(1, 40):
                stable = [e for e in tokenized(data[:n]) if e <= n - enough]
                assert stable == [e for e in whole if e <= n - enough]


def test_query_equals_library(spark, library):
    rows = {r["doc_id"]: r for r in bpe.op12_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(rows[d["doc_id"]]) == (d["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(decoded))


def test_defined_cases(spark, library):
    long = "x" * 200_000 + " y" * 100_000
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "a b", 1), (3, "a b", 1), (4, long, 2)], "doc_id int, text string, ids int")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    want = [(1, ""), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, long)]
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(i), t) for i, t in want)
    both = bpe.round_trip(docs, PATH).collect()
    assert sorted((str(r["doc_id"]), r["ids"], r["text"]) for r in both) == sorted((str(r["doc_id"]), r["ids"], r["text"]) for r in got)
    assert all(r["ids"] == library.encode(r["text"], add_special_tokens=False).ids for r in got)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [64, None, 99999, -5, 65]), (4, [164, 65])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(odd, PATH).collect()} == {1: "", 2: "", 3: library.decode([64, 65]), 4: library.decode([164, 65])}
    assert bpe.decode(bpe.encode(docs.where("false"), PATH), PATH).count() == bpe.round_trip(docs.where("false"), PATH).count() == 0


def test_rows_are_encoded_side_by_side(library, vocabulary):
    """Neighbouring rows don't touch one another: contractions, white space and special tokens at their ends, long rows between."""
    rng = random.Random(5)
    near = ["'", "s", "'s", "'r", "re", "'re", "'rest", "'l", "l", "'ll", "'Ve", " 's", "!'s", "''s", "'s's", " ", "  ", "\n", " \n", "a ", " a", "\t a", "é", "日'd", "<|endof", "text|>", "<|endoftext|>", "", "1", "x'm ", "\x1c", "\x85'"]
    rows = [w for _ in range(2000) for w in (rng.choice(near), rng.choice(near) + rng.choice(near))] + texts(6, 1000)
    rows += ["x" * 200_000, "'", "s" * 70 + " " + "ab" * 40, "-a" * 150_000, "re", "word's " * 50_000, "é", " \n" * 100_000 + "b"] + ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 90))) for _ in range(3000)]
    got = bpe.encoded_lists(rows, vocabulary)
    assert got.to_pylist() == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    assert bpe.decoded_rows(got.values.to_numpy(), got.offsets.to_numpy(), vocabulary) == rows
    halves = [ids[i : i + 3] for ids in got.to_pylist()[-3000:] for i in (0, 3)]  # characters cut in two
    ends = [0]
    for ids in halves:
        ends.append(ends[-1] + len(ids))
    flat = bpe.np.array([i for ids in halves for i in ids])
    assert bpe.decoded_rows(flat, bpe.np.array(ends), vocabulary) == library.decode_batch(halves, skip_special_tokens=False)


def test_what_is_remembered_is_bounded(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    rows = texts(7, 300)
    for i in range(0, 300, 10):
        want = [e.ids for e in library.encode_batch(rows[i : i + 10], add_special_tokens=False)]
        assert bpe.encoded_lists(rows[i : i + 10], vocabulary).to_pylist() == want
        assert len(vocabulary.remembered[0].places) < 50 + sum(map(len, rows[i : i + 10])) + 2


def test_new_words_cost_little(vocabulary):
    """CPU time of words that nothing is remembered of, against that of the pattern that finds them (one by one: some 11 times)."""
    rng = random.Random(8)
    text = " ".join("".join(rng.choice(["th", "en", "qu", "ei", "ción", "o", "a", "st"]) for _ in range(rng.randrange(3, 7))) for _ in range(100_000))
    taken = {}
    for name, f in (("pattern", lambda: vocabulary.fast.findall(text)), ("ids", lambda: list(bpe.encoded(text, vocabulary)))):
        began = time.process_time()
        f()
        taken[name] = time.process_time() - began
    assert taken["ids"] < 6 * taken["pattern"], taken


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.read_vocabulary(b'{"model": {"type": "WordPiece"}, "pre_tokenizer": null, "added_tokens": []}', bpe.patterns())
