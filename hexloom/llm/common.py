"""What the operators share: the cluster's shared folder, written tables, and a vectorised word kernel.

The word kernel works on the UTF-8 bytes of a whole Arrow column at once. Word and n-gram hashes come from prefix
sums of a polynomial hash modulo 2**64, so that any span of bytes is hashed without a Python loop.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.sources.shared import deleted, dropped, scratch, shared_dir, written  # noqa: F401

CHUNK_BYTES = 1 << 20


def _lean() -> None:
    """Make a Python worker give freed arrays back to the system at once, instead of keeping them for later.

    Workers stay alive between tasks and share their executor's memory; where the C library has no such knob, nothing
    changes.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 18)  # from this size on, blocks are mapped, and unmapped when freed
        libc.mallopt(-1, 1 << 18)  # trim the heap's top from this size on
    except (OSError, AttributeError):
        pass


_lean()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_of(df: DataFrame) -> int:
    """Catalyst's estimate of a table's size in bytes, or its texts' real size where there is no estimate."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 50 else int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def remainder(col: str, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def stratified(df: DataFrame, by: str, most: int, per: dict | None = None) -> DataFrame:
    """About ``most`` rows, chosen by a hash of ``doc_id``: as many of each value of ``by`` (null is one), all rows of a
    value that has fewer, and what those leave goes to the others. ``per`` has the rows of each value, if known."""
    per = {r[0]: r[1] for r in df.groupBy(by).count().collect()} if per is None else per
    left, share = float(most), {}
    for k, (value, n) in enumerate(sorted(per.items(), key=lambda x: x[1])):
        take = min(n, left / (len(per) - k))
        left -= take
        share[value] = take / max(1, n)
    if all(x >= 1 for x in share.values()):
        return df
    parts = [x for value, s in share.items() if value is not None for x in (F.lit(value), F.lit(int(s * (1 << 30))))]
    limit = F.lit(int(share.get(None, 0) * (1 << 30)))
    if parts:
        limit = F.when(F.col(by).isNull(), limit).otherwise(F.create_map(*parts)[F.col(by)])
    return df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit)


# ---- hashing -----------------------------------------------------------------------------------------------------

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
#: Powers of the base and of its inverse: the first ``STEP``, and every ``STEP``-th, which makes any power one product.
STEP = 4096
_low = [np.multiply.accumulate(np.concatenate([[U(1)], np.full(STEP - 1, x)])) for x in (_BASE, _INVERSE)]
_high = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def _reach(n: int) -> None:
    """Have the ``STEP``-th powers up to ``n``: kept for good, they are few."""
    if len(_high[0]) * STEP < n:
        size = -(-n // STEP) + 1
        for k, low in enumerate(_low):
            step = low[-1:] * (_BASE, _INVERSE)[k]
            _high[k] = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.repeat(step, size - 1)]))


def _up(n: int) -> np.ndarray:
    """The first ``n`` powers of the base."""
    _reach(n)
    return (_high[0][: -(-n // STEP), None] * _low[0][None, :]).ravel()[:n]


def _down(at: np.ndarray) -> np.ndarray:
    """Powers of the inverse."""
    return _high[1][at // STEP] * _low[1][at % STEP]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of the bytes' polynomial hash, for ``span_hash``."""
    out = np.zeros(len(raw) + 1, U)
    np.cumsum(_BYTE[raw] * _up(len(raw)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    _reach(len(prefix))
    h = prefix[end] - prefix[start]
    h *= _down(start)
    h ^= (end - start).astype(U) * U(0xA24BAED4963EE407)
    return mix(h)


# ---- words -------------------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """Words of some texts: byte spans, hashes, and each text's range of words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACES, lower: bool = True):
        self.raw = _LOWER[raw] if lower else raw
        inside = ~separator[self.raw] if len(raw) else np.zeros(0, bool)
        first, last = inside.copy(), inside.copy()
        if len(raw):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            heads = offsets[:-1][offsets[:-1] < len(raw)]
            first[heads] |= inside[heads]
            tails = offsets[1:][offsets[1:] > 0] - 1
            last[tails] |= inside[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.prefix = prefix_hash(self.raw)
        self.hash = span_hash(self.prefix, self.start, self.end)
        self.offsets = np.searchsorted(self.start, offsets)
        self.texts = len(offsets) - 1

    def text_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(self.texts), np.diff(self.offsets))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, off, data = column.buffers()
    n = len(column)
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, or one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    at, done = 0, 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(at, to - at)
        done, at = int(total[to - 1]), to


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    ends = np.cumsum(n)
    out[0] = s[0]
    out[ends[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
