"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (``MIN_MATCH`` words in a row) are compared by running Karp-Rabin
greedy string tiling: windows of both texts are hashed, the longest match of unmarked words is marked, and so on down
to ``MIN_MATCH`` words. An item whose marked share reaches ``COVERAGE`` is leaked, in whatever order its passages
stand in the document.

Items go to every task in blocks of at most ``BLOCK_BYTES`` of text, so what is broadcast is bounded; each block costs
one scan of the documents, which are never shuffled.

Two texts that repeat themselves share seeds by the product of their lengths. Beyond ``MOST_PAIRS`` of them (for a
document and an item) they are not listed: the greatest length of which a match is left is then found by bisection
over hashes of all windows, and the matches of that length are marked in their order, which gives the same tiles in
memory proportional to the texts.

Words are runs of letters and digits, lower-cased. Defined cases: null or empty texts have no words; items with fewer
than ``MIN_MATCH`` words can't be told from common phrases and are never reported; items with null ids take part;
repeated rows are reported once each; of equally long matches the one that begins first in the item, then in the
document, is marked; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import Words, bytes_of, gathered, mix, pieces

MIN_MATCH, COVERAGE, BLOCK_BYTES, MOST_PAIRS = 5, 0.5, 16 << 20, 200_000
SCHEMA = "doc_id long, item_id long, coverage double, n_tiles long, matched_words long, item_words long"
_BREAKS = np.ones(256, bool)
_BREAKS[48:58] = _BREAKS[97:123] = _BREAKS[128:] = False


def words_of(column: pa.Array) -> Words:
    raw, offsets = bytes_of(pc.utf8_lower(column.cast(pa.large_string())))
    return Words(raw, offsets, _BREAKS, lower=False)


def windows(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words."""
    count = len(tokens) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + tokens[k : k + count])
    return h


class Rolling:
    """Karp-Rabin hashes of word windows of any length, from prefix sums."""

    def __init__(self, tokens: np.ndarray):
        base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(tokens), base))])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens * self.up[:-1])])

    def same(self, i: int, other: Rolling, j: int, n: int) -> bool:
        """Whether ``n`` words from ``i`` on hash like the other's from ``j`` on."""
        with np.errstate(over="ignore"):
            return (self.sums[i + n] - self.sums[i]) * other.up[j] == (other.sums[j + n] - other.sums[j]) * self.up[i]


def tiles(item: np.ndarray, doc: np.ndarray, i: np.ndarray, j: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, document position, length) from the seeds at ``i`` and ``j``."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    cut = np.flatnonzero((np.diff(j - i) != 0) | (np.diff(i) != 1)) + 1
    begin = np.concatenate([[0], cut])
    length = np.diff(np.append(begin, len(i))) + least - 1
    heap = list(zip((-length).tolist(), i[begin].tolist(), j[begin].tolist(), strict=True))
    heapq.heapify(heap)
    a, b = Rolling(item), Rolling(doc)
    used_i, used_j = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        taken = used_i[p : p + n] | used_j[q : q + n]
        if taken.any():
            free = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
            for x, y in zip(free[::2].tolist(), free[1::2].tolist(), strict=True):
                if y - x >= least:
                    heapq.heappush(heap, (x - y, p + x, q + x))
        elif a.same(p, b, q, n):
            used_i[p : p + n] = used_j[q : q + n] = True
            out.append((p, q, n))
    return out


def _all_windows(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of any length, in constant time each."""
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(tokens), base))])
    down = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(tokens), inverse))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens) * up[:-1])])
    return mix((sums[n:] - sums[: len(sums) - n]) * down[: len(sums) - n])


def _free(used: np.ndarray, n: int) -> np.ndarray:
    """Where windows of ``n`` unmarked words begin."""
    total = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(total[n:] == total[: len(total) - n])


def tiles_by_length(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """The same as ``tiles``, from the texts themselves, in memory proportional to their lengths."""
    used_i, used_j = np.zeros(len(item), bool), np.zeros(len(doc), bool)

    def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free windows of ``n`` words that both have: places and hashes in the item, and in the document."""
        i, j = _free(used_i, n), _free(used_j, n)
        x, y = _all_windows(item, n)[i], _all_windows(doc, n)[j]
        in_i, in_j = np.isin(x, y), np.isin(y, x)
        return i[in_i], x[in_i], j[in_j], y[in_j]

    out = []
    most = min(len(item), len(doc))
    while most >= least:
        low, high = least - 1, most  # a match of ``low`` words is left, or low is too short; none of more than ``high``
        while low < high:
            mid = (low + high + 1) // 2
            if len(shared(mid)[0]):
                low = mid
            else:
                high = mid - 1
        if low < least:
            break
        i, x, j, y = shared(low)
        order = np.argsort(y, kind="stable")
        j, y = j[order], y[order]
        at = dict(zip(*(v.tolist() for v in np.unique(y, return_index=True)), strict=True))
        for p, key in zip(i.tolist(), x.tolist(), strict=True):
            if used_i[p : p + low].any():
                continue
            k = at[key]
            while k < len(y) and int(y[k]) == key and used_j[j[k] : j[k] + low].any():
                k += 1
            at[key] = k
            if k < len(y) and int(y[k]) == key and np.array_equal(item[p : p + low], doc[j[k] : j[k] + low]):
                q = int(j[k])
                used_i[p : p + low] = used_j[q : q + low] = True
                out.append((p, q, low))
        most = low - 1
    return out


class Block:
    """Some benchmark items with their seeds."""

    def __init__(self, ids: list, texts: pa.Array, least: int):
        w = words_of(texts)
        self.ids, self.least = ids, least
        self.items = [w.hash[w.offsets[k] : w.offsets[k + 1]] for k in range(w.texts)]
        seeds = [windows(t, least) for t in self.items]
        of = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        at = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, np.int64)
        key = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.of, self.at = key[order], of[order], at[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of seeds that some item has, and each one's place in ``key``."""
        maybe = np.flatnonzero(self.seen[(seeds & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        place = np.minimum(np.searchsorted(self.key, seeds[maybe]), len(self.key) - 1)
        good = self.key[place] == seeds[maybe]
        return maybe[good], place[good]

    def leaks(self, w: Words, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, coverage, tiles, marked words) of each leak in the texts."""
        seeds = windows(w.hash, self.least)
        where, place = self.hits(seeds)
        text = np.searchsorted(w.offsets, where, "right") - 1
        inside = where + self.least <= w.offsets[text + 1]
        where, place, text = where[inside], place[inside], text[inside]
        for k in np.unique(text):
            own = text == k
            lo = w.offsets[k]
            doc = w.hash[lo : w.offsets[k + 1]]
            pos, first = where[own] - lo, place[own]
            seed, which, times = np.unique(first, return_inverse=True, return_counts=True)
            n = np.searchsorted(self.key, self.key[seed], "right") - seed
            entry, of = gathered(seed, n), np.repeat(np.arange(len(seed)), n)  # each place of an item once
            order = np.argsort(self.of[entry], kind="stable")
            entry, of = entry[order], of[order]
            present, begin = np.unique(self.of[entry], return_index=True)
            by_seed = np.argsort(which, kind="stable")
            starts = np.cumsum(times) - times
            for x, a, b in zip(present.tolist(), begin.tolist(), np.append(begin[1:], len(entry)).tolist(), strict=True):
                size = len(self.items[x])
                i = self.at[entry[a:b]]
                inside = np.zeros(size + 1, np.int64)
                np.add.at(inside, i, 1)
                np.add.at(inside, i + self.least, -1)
                if (np.cumsum(inside[:size]) > 0).sum() < coverage * size:
                    continue  # not even all seeds together
                each = times[of[a:b]]
                if each.sum() > MOST_PAIRS:
                    found = tiles_by_length(self.items[x], doc, self.least)
                else:
                    found = tiles(self.items[x], doc, np.repeat(i, each), pos[by_seed[gathered(starts[of[a:b]], each)]], self.least)
                marked = sum(t[2] for t in found)
                if marked >= coverage * size:
                    yield int(k), int(x), marked / size, len(found), marked


def blocks(benchmark: DataFrame, least: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of the benchmark's items, each of a bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    out = []
    for b in range(n):
        got = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).toArrow() if n > 1 else items.toArrow()
        if got.num_rows:
            out.append(spark.sparkContext.broadcast(Block(got.column("item_id").to_pylist(), got.column("text").combine_chunks(), least)))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item of which the document covers enough."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for sent in blocks(benchmark, least, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                for part in pieces(batch, "text"):
                    found = list(block.leaks(words_of(part.column("text")), coverage))
                    if found:
                        k, x, share, n, marked = zip(*found, strict=True)
                        arrays = [part.column("doc_id").take(pa.array(k)), pa.array([block.ids[i] for i in x], pa.int64()), pa.array(share), pa.array(n), pa.array(marked), pa.array([len(block.items[i]) for i in x])]
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "coverage", "n_tiles", "matched_words", "item_words"])

        out = out.unionByName(rows.mapInArrow(run, SCHEMA))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """The documents without a leak, all columns kept."""
    for sent in blocks(benchmark, least):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                for part in pieces(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[k for k, *_ in block.leaks(words_of(part.column("text")), coverage)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    """``op4_decontaminate``: all leaks of ``benchmark`` in ``documents``."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents with a leak go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
