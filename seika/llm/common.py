"""Helpers shared by the operators: session settings, Arrow text access, hashing.

Texts reach Python as Arrow batches; ``texts_of`` views a string column as one
byte buffer plus offsets, so that the numpy operators work on UTF-8 bytes
without making Python strings. 64-bit hashes wrap modulo 2**64 (unsigned).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seika.session import configure

# The white space of the contracts: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"

# Rows of a batch that go to Python at once; a batch of long texts stays small.
BATCH_ROWS = "512"


def prepare(spark: SparkSession) -> SparkSession:
    """Library settings plus small Arrow batches (bounded worker memory)."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_keys(doc_id, text) -> list["F.Column"]:
    """t0 and t1: 128 bits that name a row by its doc_id and text; equal rows have equal keys. A null text is an empty one, a null doc_id is none other."""
    parts = (doc_id.isNull(), F.coalesce(doc_id, F.lit(0).cast("long")), F.coalesce(text, F.lit("").cast("string")))
    return [F.xxhash64(*parts).alias("t0"), F.xxhash64(F.lit("second"), *parts).alias("t1")]


# Rows of a small key table that may be broadcast, at up to BROADCAST_BYTES in all.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def small_enough(rows: DataFrame, *texts: str) -> bool:
    """Whether a (staged) table of keys may be broadcast: few rows, and few bytes in its string columns ``texts``."""
    size = sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts), F.lit(0))
    n, there = rows.agg(F.count(F.lit(1)), size).first()
    return n <= BROADCAST_ROWS and there <= BROADCAST_BYTES


def texts_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is ``bytes[offsets[i]:offsets[i + 1]]``; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind, n + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``limit`` bytes together (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Polynomial hashes of byte ranges, from one prefix sum.

    Byte values are first replaced by random odd 64-bit numbers of ``seed``.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**61, 2**62)) * 8 + 5  # odd, so it has an inverse
        self.inverse = pow(self.base, -1, 2**64)
        self.base %= 2**64
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, 1 << 16)
            for name, b in (("_up", self.base), ("_down", self.inverse)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._powers(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self._up[:n], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes [start, end), the same wherever they stand."""
        return (prefix[end] - prefix[start]) * self._down[start]


_WORDS = RollingHash(11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) of
    texts in one buffer, and the number of words of each text.

    Works on pieces of ``piece`` bytes cut before white space or between texts,
    so memory follows the piece, not the longest text.
    """
    n = len(data)
    hashes, firsts, lo = [], [], 0
    while lo < n:
        hi = min(lo + piece, n)
        if hi < n:
            # A cut must not fall inside a word: go back to a space or a text's start, else on to the next.
            back = np.flatnonzero(_IS_SPACE[data[lo:hi]])
            k = int(np.searchsorted(offsets, hi, side="right")) - 1
            cut = max(lo + int(back[-1]) if len(back) else 0, int(offsets[k]))
            if cut <= lo:
                ahead = hi
                while ahead < n:
                    found = np.flatnonzero(_IS_SPACE[data[ahead:ahead + piece]])
                    if len(found):
                        ahead += int(found[0])
                        break
                    ahead += piece
                cut = min(ahead, n, int(offsets[k + 1]) if k + 1 < len(offsets) else n)
            hi = cut
        part = data[lo:hi]
        word = ~_IS_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)  # a text begins here
        inside = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi, side="right")] - lo
        edge[inside] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        end = word.copy()
        end[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if len(starts):
            pre = _WORDS.prefix(_LOWER[part])
            hashes.append(mix64(_WORDS.of(pre, starts, ends) + (ends - starts).astype(np.uint64)))
            firsts.append(starts + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), np.diff(np.searchsorted(first, offsets))
