"""Words of whole texts as NumPy arrays, for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes each, so that word lists stay small; a long text comes alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word; bytes.split() separates at just the space and TAB to CR."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(rows: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of equally long columns, dependent on their order."""
    h = np.full(len(rows[0]), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for r in rows:
        h = (h ^ r) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `words` words, A-Z lower-cased; a shorter text is one shingle."""
    h = word_hashes(text.lower())
    if len(h) == 0:
        return h
    k = min(words, len(h))
    return np.unique(mixed([h[i : len(h) - k + 1 + i] for i in range(k)] + [np.full(len(h) - k + 1, k, dtype=np.uint64)]))
