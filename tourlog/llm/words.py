"""Words of texts as bytes and numbers, shared by the operators that score batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# A-Z to a-z, byte by byte; bytes.split() parts at exactly [\x20\x09-\x0D]
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# words kept in a worker's table of hashes
CACHED_WORDS = 400_000
# bytes of a batch that are worked on at once
PIECE_BYTES = 1 << 20

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def contents(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most PIECE_BYTES (one row at least), and memory back in the end.

    What a worker makes of a batch stays small, whatever the batch holds; a
    worker that waits for the next stage keeps no buffers.
    """
    for b in batches:
        rows = max(1, b.num_rows * PIECE_BYTES // max(b.nbytes, 1))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
    pa.default_memory_pool().release_unused()


class Recent:
    """A table of results for keys, which forgets keys not used for a while.

    Two generations of at most ``size`` keys each: a full one becomes the old
    one, and what is used again moves on.
    """

    def __init__(self, make, size: int):
        self.make, self.size = make, size
        self.new: dict = {}
        self.old: dict = {}

    def __call__(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(self.new) >= self.size:
                self.old, self.new = self.new, {}
            self.new[key] = found
        return found


class WordHashes(dict):
    """Seeded 64-bit hashes of words, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashes(words: list[bytes], table: WordHashes) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))
