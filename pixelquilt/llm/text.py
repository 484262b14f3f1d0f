"""Small helpers shared by the operators: words, stable hashes, document columns and Arrow passes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words as long; NULL counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; NULL keys give 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_INSIDE = ~_SPACE
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)     # of the first i bytes of eight


class Words:
    """Words of some texts as 64-bit hashes, found and hashed without a Python step per word.

    hashes, owner: one entry per word in text order; counts: words per text; starts, sizes: places in `bytes`, the
    texts one after the other, a space after each. A hash runs over the word eight bytes at a time."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        self.lengths = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
        joined = b" ".join([*(t or b"" for t in texts), b""])
        raw = np.frombuffer(joined + bytes(8), np.uint8)
        if lower:
            raw = _LOWER[raw]
        b = self.bytes = raw[:len(joined)]
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = _INSIDE[b]
        self.starts = starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        self.sizes = sizes = np.flatnonzero(inside[:-1] & ~inside[1:]) - starts
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
        h = mixed(sizes.astype(np.uint64))
        rows, done = slice(None), 0
        at, left = starts, sizes
        while len(at):
            h[rows] = mixed(h[rows] ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
            more = np.flatnonzero(left > 8)
            rows = more if done == 0 else rows[more]
            at, left, done = at[more] + 8, left[more] - 8, done + 1
        self.hashes = h
        ends = np.cumsum(self.lengths)
        upto = np.searchsorted(starts, ends)
        self.counts = np.diff(upto, prepend=0)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)

    def byte_owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of `width` word hashes; empty for fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return words[:0]
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mixed(out + words[i:i + n])
    return out


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The texts of a batch as UTF-8 bytes."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", rows: int = 64,
           mb: float = 0.5) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most `rows` rows and about `mb` megabytes of text, so temporaries stay in
    the cache."""
    for batch in batches:
        size = batch.column(name).nbytes
        step = max(1, min(rows, int(len(batch) * mb * 1e6 / max(size, 1))))
        for i in range(0, len(batch), step):
            yield batch.slice(i, step)


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the wanted columns, whatever else (or whichever clashing name) the input carries."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))
