"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

``train`` counts the word trigrams of all trusted documents in the cluster, and derives the model from the counts: raw
ones for trigrams, numbers of distinct predecessors for lower orders, three discounts an order from the counts of counts,
and each context's left-over mass. The logarithm of an interpolated probability is then a sum over n-grams: every n-gram
of the model gets what it adds to its backoff, plus its mass as the context of the next word, and a text's log
probability is the sum of these values over its n-grams, above that of as many unknown words.

The fit is made of joins and sorts that may spill. Trigrams are shuffled once, by their middle word, which the context of
a trigram, its backoff and that one's context share; what each n-gram adds travels in blobs to the n-gram's cell, one of
as many ranges of the hash as the model asks for. To keep less on disk at once, trigrams are counted in ``SHARES`` shares
of the middle words, each of which is another pass over the trusted texts; a share is deleted when its blobs are written,
and blobs when their cells are. The driver holds the ``HOT`` most frequent n-grams and a bit filter of
the others (at most 2^``SEEN_BITS`` bits: beyond that more n-grams are asked in vain, with the same result).

Scoring is a join of the documents' n-grams with the model, summed by document. One pass over the texts adds up the
values of the hot n-grams, drops those which the filter tells are not in the model, and packs what is left into blobs by
cell; blobs meet the model's cell, and the partial sums, at most one for each document and cell, meet the documents in a
join. Cells stand in as many copies as the input asks for, and the blobs are dealt over the copies, so that what meets
in one task doesn't grow with the input; and what many texts share is hot and isn't sent. To keep less on disk at once,
texts are scored in ``PARTS`` parts, and cells are made and met in ``ROUNDS`` rounds; shuffled files and broadcasts go as
soon as they were used.

Half of the trusted documents (by a hash of the id) teach the model, all of the other half set the thresholds: a model
knows its own texts too well to say what is usual. Neither half is sampled, counts and quantiles are exact, and scoring
covers whole texts of all rows.

A document's mean log probability is drawn towards the trusted mean of its language by ``STEADY`` words, so that a few
unknown words don't condemn a short text. It is kept if its perplexity is at most the language's threshold: the
quantile ``QUANTILE`` of trusted documents, times ``SLACK``.

Defined cases: texts without words (null, empty) have no perplexity and are not kept; languages without enough trusted
documents, and null, take the threshold of all; without trusted rows all texts with words are kept; repeated rows get
a row each; an empty table gives no rows; further columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hexloom.llm.common import Words, bytes_of, deleted, dropped, mix, pieces, scratch, size_of, stratified, written
from hexloom.llm.lm_scoring import pack, unpack

U = np.uint64
STEADY, QUANTILE, SLACK, ENOUGH = 30.0, 0.995, 1.1, 50
FLUSH_GRAMS, FLUSH_HITS, FLUSH_ROWS = 1_000_000, 1_000_000, 60_000
HOT, SLOT_BITS, CELL_BITS, CELL_GRAMS, SEEN_BITS, COPY_BYTES = 1 << 18, 19, 6, 1 << 19, 28, 512 << 20
SENT_ROWS, SENT_WORDS, SHARES, ROUNDS, PARTS = 500_000, 4_000_000, 2, 4, 4
SALTS = (U(0x9FB21C651E98DF25), U(0xC2B2AE3D27D4EB4F))
END, BEGIN = mix(np.array([211], U))[0], mix(np.array([223], U))[0]
_K = U(0x9E3779B97F4A7C15)


@contextmanager
def _freeing(spark) -> Iterator[None]:
    """Delete shuffled files as soon as the table that they were for is written; nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _sequence(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts with words: each predicted token with the two before it, and its text."""
    n = np.diff(w.offsets)
    full = n > 0
    z = np.insert(w.hash, w.offsets[1:][full], END)
    of = np.repeat(np.flatnonzero(full), n[full] + 1)
    first = np.concatenate([[0], np.cumsum(n[full] + 1)[:-1]]).astype(np.int64) if full.any() else np.zeros(0, np.int64)
    y, x = np.full(len(z), BEGIN), np.full(len(z), BEGIN)
    y[1:], x[2:] = z[:-1], z[:-2]
    y[first] = BEGIN
    x[first] = BEGIN
    second = first + 1
    x[second[second < len(z)]] = BEGIN
    return x, y, z, of


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from those of its beginning and its last word."""
    return mix(a * _K + b)


def _count(rows: DataFrame, share: int) -> DataFrame:
    """Distinct trigrams (by the hash of their first two words, and the hashes of the last two) of a share of the middle
    words, and their counts, added up in each task before they are shuffled by their middle word."""

    def flush(held: list) -> pa.RecordBatch:
        xy, y, z, n = (np.concatenate(c) for c in zip(*held, strict=True))
        _, first, which = np.unique(pair(xy, z), return_index=True, return_inverse=True)
        n = np.bincount(which, weights=n, minlength=len(first)).astype(np.int64)
        order = np.argsort(y[first])  # equal words beside each other compress
        first, n = first[order], n[order]
        return pa.RecordBatch.from_arrays([*[pa.array(v[first].view(np.int64)) for v in (xy, y, z)], pa.array(n)], names=["xy", "y", "z", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch, "text"):
                x, y, z, _ = _sequence(Words(*bytes_of(part.column("text"))))
                own = np.flatnonzero((y >> U(32)) % U(SHARES) == share)
                x, y, z = x[own], y[own], z[own]
                xy = pair(x, y)
                _, first, n = np.unique(pair(xy, z), return_index=True, return_counts=True)
                held.append((xy[first], y[first], z[first], n))
                size += len(first)
                if size > FLUSH_GRAMS:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    counts = rows.select("text").mapInArrow(run, "xy long, y long, z long, n long")
    return counts.repartition("y").groupBy("y", "xy", "z").agg(F.sum("n").alias("n"))


def _contexts(tri: DataFrame) -> DataFrame:
    """Trigrams with what their context and their backoff count, without another shuffle: ``t3`` is the context's total,
    ``k3`` its number of n-grams, and ``p3`` those of them that occur once, and in the upper 32 bits twice; ``n2`` is the
    bigram's number of predecessors, ``o2`` how often it occurs; ``t2``, ``k2`` and ``p2`` are those of the bigram's context.
    ``f3``, ``f2``, ``f1`` mark one row of each trigram context, bigram and bigram context."""

    def few(n, of=F.lit(True)):
        return F.sum(F.when(of & (n == 1), 1).when(of & (n == 2), 1 << 32).otherwise(0))

    by3, by2, by1 = Window.partitionBy("y", "xy"), Window.partitionBy("y", "z"), Window.partitionBy("y")
    f2 = F.col("f2")
    tri = tri.select("*", F.sum("n").over(by3).alias("t3"), F.count("*").over(by3).alias("k3"), few(F.col("n")).over(by3).alias("p3"), (F.min("z").over(by3) == F.col("z")).alias("f3"))
    tri = tri.select("*", F.count("*").over(by2).alias("n2"), F.sum("n").over(by2).alias("o2"), (F.min("xy").over(by2) == F.col("xy")).alias("f2"))
    return tri.select("*", F.count("*").over(by1).alias("t2"), F.sum(f2.cast("long")).over(by1).alias("k2"), few(F.col("n2"), f2).over(by1).alias("p2"), (f2 & (F.min("z").over(by1) == F.col("z"))).alias("f1"))


def _discounts(counts: list[int]) -> np.ndarray:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (max(1, k) for k in counts)
    base = n1 / (n1 + 2 * n2)
    return np.array([min(max(d, 0.05), cap) for d, cap in ((1 - 2 * base * n2 / n1, 0.95), (2 - 3 * base * n3 / n2, 1.9), (3 - 4 * base * n4 / n3, 2.85))])


def _cut(discounts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return discounts[np.minimum(n, 3) - 1]


def _tell(rows: DataFrame, add, cell_bits: int) -> DataFrame:
    """What ``add`` finds that n-grams add, and how often these occur, in blobs by the n-gram's cell, and the round whose
    turn it is then."""

    def flush(held: list) -> pa.RecordBatch:
        key, value, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(key)
        key, value, n = key[order], value[order], n[order]
        cells, cut = _by_cell(key, cell_bits)
        blobs = [pa.array([pack_keys(key[a:b]) for a, b in cut], pa.binary()), *[pa.array([pack(v[a:b]) for a, b in cut], pa.binary()) for v in (value, n)]]
        return pa.RecordBatch.from_arrays([pa.array(cells), *blobs, pa.array(cells % ROUNDS)], names=["cell", "keys", "values", "counts", "turn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                told = add({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
                new = [(key, value.astype(np.float32), n.astype(np.int64)) for key, value, n in told]
                held += new
                size += sum(len(k) for k, _, _ in new)
                if size > FLUSH_GRAMS:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return rows.mapInArrow(run, "cell long, keys binary, values binary, counts binary, turn long")


def _by_cell(key: np.ndarray, cell_bits: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The cells of sorted keys, and each one's range."""
    cells, begin = np.unique(key >> U(64 - cell_bits), return_index=True)
    return cells.astype(np.int64), list(zip(begin.tolist(), np.append(begin[1:], len(key)).tolist(), strict=True))


def pack_keys(key: np.ndarray) -> bytes:
    """Sorted hashes by their differences."""
    return pack(np.diff(key, prepend=U(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, U), dtype=U)


@dataclass
class Model:
    """What each n-gram adds: a table of slots with the most frequent ones, a filter of all, and a table of cells, which
    tasks read; a model of arrays has ``keys`` and ``values`` of those without a slot instead.
    ``start`` is what every text with words has besides, ``unknown`` the log probability of an unknown word."""

    slots: np.ndarray
    slot_values: np.ndarray
    seen: np.ndarray
    unknown: float
    start: float
    cell_bits: int = CELL_BITS
    cells: DataFrame | None = None
    keys: np.ndarray | None = None
    values: np.ndarray | None = None

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray, counts: np.ndarray, unknown: float, start: float) -> Model:
        """From distinct hashes, their values, and how often they occurred."""
        order = np.argsort(keys)
        keys, values, counts = keys[order], values[order].astype(np.float32), counts[order]
        often = np.argsort(counts, kind="stable")[max(0, len(keys) - HOT) :]
        slots, slot_values = _slots(keys[often], values[often], counts[often])
        rest = slots[(keys >> U(64 - SLOT_BITS)).astype(np.int64)] != keys
        keys, values = keys[rest], values[rest]
        return cls(slots, slot_values, _filter(keys, _seen_bits(len(keys), CELL_BITS), CELL_BITS), unknown, start, keys=keys, values=values)

    def hot(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the n-grams that the slots hold (0 for others), and which of the others may be in the model."""
        at = (key >> U(64 - SLOT_BITS)).astype(np.int64)
        hit = self.slots[at] == key
        maybe = ~hit
        bits = (8 * len(self.seen) - 1).bit_length()
        for salt in SALTS:
            rest = np.flatnonzero(maybe)
            at_bit = _bit(key[rest], salt, bits, self.cell_bits)
            maybe[rest] = self.seen[at_bit >> 3] >> (at_bit & 7).astype(np.uint8) & 1 > 0
        return np.where(hit, self.slot_values[at], 0.0), maybe


def _slots(keys: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots by the leading bits of the hash; of n-grams that fall into one, the most frequent."""
    order = np.lexsort((keys, counts))
    slots, slot_values = np.zeros(1 << SLOT_BITS, U), np.zeros(1 << SLOT_BITS, np.float32)
    slot = (keys[order] >> U(64 - SLOT_BITS)).astype(np.int64)
    slots[slot], slot_values[slot] = keys[order], values[order]
    return slots, slot_values


def _seen_bits(n: int, cell_bits: int) -> int:
    """The filter's size for n n-grams, as a power of 2."""
    return max(10 + cell_bits, min(SEEN_BITS, (16 * n).bit_length()))


def _bit(key: np.ndarray, salt: np.uint64, bits: int, cell_bits: int) -> np.ndarray:
    """Places in a filter of 2^bits bits, of which each cell has a stretch."""
    low = U(bits - cell_bits)
    return (key >> U(64 - cell_bits) << low | key * salt >> U(64) - low).astype(np.int64)


def _filter(keys: np.ndarray, bits: int, cell_bits: int) -> np.ndarray:
    seen = np.zeros(1 << (bits - 3), np.uint8)
    for salt in SALTS:
        at = _bit(keys, salt, bits, cell_bits)
        np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return seen


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, bigrams and trigrams whose values make up each text's sum, and each one's text; and the
    number of tokens (words and one end) of each text, 0 without words."""
    w = Words(*bytes_of(column))
    x, y, z, of = _sequence(w)
    yz = pair(y, z)
    keys = np.concatenate([word(z), yz, pair(pair(x, y), z)])
    return keys, np.concatenate([of, of, of]), np.bincount(of, minlength=w.texts)


def word(a: np.ndarray) -> np.ndarray:
    return mix(a + U(0x632BE59BD9B4E019))


def train(trusted: DataFrame, max_docs: int | None = None) -> Model | None:
    """Fit on the ``text`` of all trusted rows; with ``max_docs`` on about as many, drawn by ``lang``."""
    if max_docs is not None:
        trusted = stratified(trusted, "lang", max_docs)
    with scratch(), _freeing(trusted.sparkSession):
        return _train(trusted)


def _train(trusted: DataFrame) -> Model | None:
    shares = [written(_contexts(_count(trusted, k)), "trigrams") for k in range(SHARES)]
    tri = reduce(DataFrame.unionAll, shares)
    some = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    first2 = F.col("f2")
    got = tri.agg(F.count("*"), some(first2), *[some(F.col("n") == k) for k in range(1, 5)], *[some(first2 & (F.col("n2") == k)) for k in range(1, 5)]).first()
    if not got[0]:
        return None
    uni = written(tri.filter("f2").groupBy("z").agg(F.count("*").alias("n1"), F.sum("o2").alias("o1")), "words")
    words = uni.agg(F.count("*"), F.sum("n1"), *[some(F.col("n1") == k) for k in range(1, 5)], some(F.col("n1") > 2)).first()
    d3, d2, d1 = _discounts(got[2:6]), _discounts(got[6:10]), _discounts(words[2:6])
    unknown = float(d1 @ [words[2], words[3], words[6]]) / words[1] / (words[0] + 1)
    total1 = words[1]
    grams = got[0] + got[1] + words[0]
    cell_bits = max(CELL_BITS, (-(-grams // CELL_GRAMS) - 1).bit_length())
    begin, twice = (int(h.view(np.int64)) for h in (BEGIN, pair(np.array([BEGIN]), np.array([BEGIN]))[0]))

    def p1(n: np.ndarray) -> np.ndarray:
        return (n - _cut(d1, n)) / total1 + unknown

    def mass(c: dict, order: int) -> np.ndarray:
        """Left-over mass of the contexts of an order's n-grams."""
        d, total, kinds, few = (d3 if order == 3 else d2), *(c[f"{k}{order}"] for k in "tkp")
        once, twice = few & 0xFFFFFFFF, few >> 32
        return (d[0] * once + d[1] * twice + d[2] * (kinds - once - twice)) / total

    def of_words(c: dict) -> list:
        return [(word(c["z"].view(U)), np.log(p1(c["n1"]) / unknown), c["o1"])]

    def of_trigrams(c: dict) -> list:
        """Trigrams, their backoffs, and the masses of both contexts, which count for what was predicted before."""
        xy, y, z = (c[k].view(U) for k in ("xy", "y", "z"))
        n1 = sent.value[1][np.searchsorted(sent.value[0], c["z"])] if few else c["n1"]
        m3, m2, low = mass(c, 3), mass(c, 2), p1(n1)
        p2 = (c["n2"] - _cut(d2, c["n2"])) / c["t2"] + m2 * low
        p3 = (c["n"] - _cut(d3, c["n"])) / c["t3"] + m3 * p2
        f2, f3, f1 = c["f2"], c["f3"] & (c["xy"] != twice), c["f1"] & (c["y"] != begin)
        none = np.zeros(len(y), np.int64)
        return [
            (pair(xy, z), np.log(p3) - np.log(m3) - np.log(p2), c["n"]),
            (pair(y, z)[f2], (np.log(p2) - np.log(m2) - np.log(low))[f2], c["o2"][f2]),
            (xy[f3], np.log(m3)[f3], none[f3]),
            (word(y)[f1], np.log(m2)[f1], none[f1]),
        ]

    # what comes before the first word is the same in all texts
    starts = tri.filter(((F.col("xy") == twice) & F.col("f3")) | ((F.col("y") == begin) & F.col("f1"))).collect()
    start = sum(float(np.log(mass(r.asDict(), 3))) for r in starts if r["f3"] and r["xy"] == twice) + sum(float(np.log(mass(r.asDict(), 2))) for r in starts if r["f1"] and r["y"] == begin)
    few = words[0] <= SENT_WORDS  # 16 bytes each
    if few:
        below = uni.select("z", "n1").toArrow()
        below = below.take(np.argsort(below.column("z").to_numpy()))
        sent = tri.sparkSession.sparkContext.broadcast((below.column("z").to_numpy(), below.column("n1").to_numpy()))
    bits = _seen_bits(grams, cell_bits)
    told = [written(_tell(uni, of_words, cell_bits), "told", by="turn")]
    for share in shares:
        if few:
            told.append(written(_tell(share, of_trigrams, cell_bits), "told", by="turn"))
        else:  # a part of the words at a time, as what is joined is shuffled
            for k in range(ROUNDS):
                used = share.filter(F.pmod("z", F.lit(ROUNDS)) == k).join(uni.select("z", "n1"), "z")
                told.append(written(_tell(used, of_trigrams, cell_bits), "told", by="turn"))
        dropped(share)
    if few:
        sent.destroy()  # a broadcast stays on the disks of all executors
    cells = None
    for turn in range(ROUNDS):  # a part of the cells at a time, as what is shuffled takes as much disk as the model
        now = reduce(DataFrame.unionAll, [t.filter(F.col("turn") == turn).drop("turn") for t in told])
        done = written(now.groupBy("cell").applyInArrow(_cell(bits, cell_bits), "cell long, known binary, values binary, counts binary, seen binary"), "cells", keep=True)
        cells = done if cells is None else cells.unionAll(done)
        for t in told:
            deleted(t.sparkSession, f"{t._hexloom_path}/turn={turn}")
    slots = _slots(*_most_frequent(cells))
    seen = np.zeros(1 << (bits - 3), np.uint8).reshape(1 << cell_bits, -1)
    for r in cells.select("cell", "seen").toLocalIterator():
        seen[r["cell"]] = np.frombuffer(r["seen"], np.uint8)
    return Model(*slots, seen.ravel(), float(np.log(unknown)), start, cell_bits, cells.select("cell", "known", "values"))


def _cell(bits: int, cell_bits: int):
    """Of one cell: what its n-grams add in sum, how often they occur, and its stretch of the filter."""

    def run(table: pa.Table) -> pa.Table:
        key, value, n = (np.concatenate([f(b) for b in table.column(c).to_pylist()]) for c, f in (("keys", unpack_keys), ("values", lambda b: unpack(b, np.float32)), ("counts", lambda b: unpack(b, np.int64))))
        key, which = np.unique(key, return_inverse=True)
        value = np.bincount(which, weights=value, minlength=len(key)).astype(np.float32)
        n = np.bincount(which, weights=n, minlength=len(key)).astype(np.int64)
        low = U((1 << (bits - cell_bits)) - 1)
        seen = np.zeros(1 << (bits - cell_bits - 3), np.uint8)
        for salt in SALTS:
            at = (_bit(key, salt, bits, cell_bits).view(U) & low).astype(np.int64)
            np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        row = [table.column("cell")[0].as_py(), pack_keys(key), pack(value), pack(n), seen.tobytes()]
        return pa.table({c: pa.array([v], t) for c, v, t in zip(("cell", "known", "values", "counts", "seen"), row, [pa.int64(), *[pa.binary()] * 4], strict=True)})

    return run


def _most_frequent(cells: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, values and counts of all n-grams that occur as often as makes at most ``HOT``."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("counts").to_pylist():
                n, k = np.unique(unpack(raw, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(k)], names=["n", "k"])

    found = cells.select("counts").mapInArrow(tally, "n long, k long").groupBy("n").agg(F.sum("k").alias("k"))
    up = Window.orderBy(F.col("n").desc())
    least = found.select("n", F.sum("k").over(up).alias("k")).filter(F.col("k") <= HOT).agg(F.min("n")).first()[0]

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for known, values, counts in zip(*(batch.column(c).to_pylist() for c in ("known", "values", "counts")), strict=True):
                n = unpack(counts, np.int64)
                at = np.flatnonzero(n >= least)
                yield pa.RecordBatch.from_arrays([pa.array(unpack_keys(known)[at].view(np.int64)), pa.array(unpack(values, np.float32)[at]), pa.array(n[at])], names=["key", "value", "n"])

    if least is None:
        return np.zeros(0, U), np.zeros(0, np.float32), np.zeros(0, np.int64)
    got = cells.select("known", "values", "counts").mapInArrow(top, "key long, value float, n long").toArrow()
    return got.column("key").to_numpy().view(U), got.column("value").to_numpy(), got.column("n").to_numpy()


def perplexities(df: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``df`` but ``text``, with ``log_sum`` and ``n_tokens``."""
    part = F.pmod(F.xxhash64("text"), F.lit(PARTS))
    done = None
    with _freeing(df.sparkSession):
        for k in range(PARTS):  # a part of the texts at a time, as their n-grams take as much disk as the model
            with scratch():
                logs = _perplexities(df.filter(part == k), model)
            done = logs if done is None else done.unionAll(logs)
    return done


def _perplexities(df: DataFrame, model: Model | None) -> DataFrame:
    from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

    spark, text = df.sparkSession, df.columns.index("text")
    own = [(f"c{k}", f) for k, f in enumerate(df.schema.fields) if k != text]
    extra = [("row", LongType()), ("part", DoubleType()), ("tokens", LongType()), ("cell", LongType()), ("copy", LongType()), ("base", LongType()), ("keys", BinaryType()), ("rows", BinaryType())]
    schema = StructType([*[StructField(n, f.dataType, True) for n, f in own], *[StructField(n, t) for n, t in extra]])
    cell_bits = model.cell_bits if model else CELL_BITS
    copies = max(1, size_of(df) // (COPY_BYTES << cell_bits - CELL_BITS))
    sent = spark.sparkContext.broadcast(model and (model.slots, model.slot_values, model.seen, model.unknown, model.start, cell_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value and Model(*sent.value)
        row = TaskContext.get().partitionId() << 40
        names = [n for n, _ in own]
        kinds = pa.schema([(n, b) for n, b in [("cell", pa.int64()), ("copy", pa.int64()), ("base", pa.int64()), ("keys", pa.binary()), ("rows", pa.binary())]])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count, base = 0, row

        def flush() -> pa.RecordBatch:
            key, of = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(key)
            key, of = key[order], of[order]
            cells, cut = _by_cell(key, cell_bits)
            copy = int(mix(np.array([base], np.int64).view(U))[0] % U(copies))
            got = [pa.array(cells), pa.array(np.full(len(cells), copy)), pa.array(np.full(len(cells), base)), pa.array([pack_keys(key[a:b]) for a, b in cut], pa.binary()), pa.array([pack(of[a:b]) for a, b in cut], pa.binary())]
            return whole(dict(zip(kinds.names, got, strict=True)), len(cells))

        def whole(cols: dict, n: int) -> pa.RecordBatch:
            target = to_arrow_schema(schema)
            return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(n, f.type) for f in target], schema=target)

        for batch in batches:
            for part in pieces(batch.rename_columns([f"c{k}" for k in range(batch.num_columns)]), f"c{text}"):
                n = part.num_rows
                if row + n - base > FLUSH_ROWS and held:
                    yield flush()
                    held, count, base = [], 0, row
                if not held:
                    base = row
                cols = {c: part.column(c) for c in names} | {"row": pa.array(np.arange(row, row + n))}
                if m is None:
                    tokens = np.diff(Words(*bytes_of(part.column(f"c{text}"))).offsets)
                    tokens, sums = np.where(tokens > 0, tokens + 1, 0), np.zeros(n)
                else:
                    key, of, tokens = _grams(part.column(f"c{text}"))
                    value, maybe = m.hot(key)
                    sums = np.bincount(of, weights=value, minlength=n) + np.where(tokens > 0, tokens * m.unknown + m.start, 0.0)
                    if maybe.any():
                        held.append((key[maybe], (of[maybe] + (row - base)).astype(np.uint32)))
                        count += len(held[-1][0])
                yield whole(cols | {"part": pa.array(sums), "tokens": pa.array(tokens.astype(np.int64))}, n)
                row += n
                if count > FLUSH_HITS:
                    yield flush()
                    held, count, base = [], 0, row
        if held:
            yield flush()

    def add(asked: pa.Table, cell: pa.Table) -> pa.Table:
        rows, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        if cell.num_rows:
            known, value = unpack_keys(cell.column("known")[0].as_py()), unpack(cell.column("values")[0].as_py(), np.float32)
            for base, keys, of in zip(*(asked.column(c) for c in ("base", "keys", "rows")), strict=True):
                key, of = unpack_keys(keys.as_py()), unpack(of.as_py(), np.uint32)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key
                if hit.any():  # else all of them passed the filter by chance
                    own, of = np.unique(of[hit], return_inverse=True)
                    rows.append(base.as_py() + own.astype(np.int64))
                    sums.append(np.bincount(of, weights=value[at[hit]].astype(np.float64), minlength=len(own)))
        return pa.table({"row": np.concatenate(rows), "sum": np.concatenate(sums)})

    found = written(df.mapInArrow(run, schema), "grams")
    sent.destroy()  # a broadcast stays on the disks of all executors
    docs = found.filter("row IS NOT NULL")
    named = [F.col(n).alias(f.name) for n, f in own]
    if model is None:
        return written(docs.select(*named, F.col("part").alias("log_sum"), F.col("tokens").alias("n_tokens")), "logs", keep=True)
    blobs = found.filter("row IS NULL").select("cell", "copy", "base", "keys", "rows")
    cells = model.cells.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    sums = None
    for k in range(ROUNDS):  # a part of the cells at a time, as what is shuffled takes as much disk as the model and the blobs
        now = F.col("cell") % ROUNDS == k
        parts = blobs.filter(now).groupBy("cell", "copy").cogroup(cells.filter(now).groupBy("cell", "copy")).applyInArrow(add, "row long, sum double")
        done = written(parts.groupBy(F.col("row").alias("of_row")).agg(F.sum("sum").alias("sum")), "sums")
        sums = done if sums is None else sums.unionAll(done)
    sums = sums.groupBy("of_row").agg(F.sum("sum").alias("sum"))
    joined = docs.join(sums, docs["row"] == sums["of_row"], "left")
    return written(joined.select(*named, (F.col("part") + F.coalesce("sum", F.lit(0.0))).alias("log_sum"), F.col("tokens").alias("n_tokens")), "logs", keep=True)


def _ranked(values: DataFrame, quantile: float, *by: str) -> DataFrame:
    """Of each group: the least ``s`` that at least that part of the rows doesn't exceed, and the number of rows ``n``."""
    group = Window.partitionBy(*by)
    at = values.select(*by, "s", F.count("*").over(group).alias("n"), F.row_number().over(group.orderBy("s")).alias("at"))
    return at.filter(F.col("at") == F.greatest(F.lit(1), F.ceil(F.lit(quantile) * F.col("n")))).select(*by, F.col("s").alias("q"), "n")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """Per document: lang, n_tokens, perplexity, the language's threshold, and whether it is kept."""
    with scratch():
        return _classify(docs, labels, quantile, slack)


def _classify(docs: DataFrame, labels: DataFrame, quantile: float, slack: float) -> DataFrame:
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    chosen = written(good.filter(half == 0), "chosen")
    few = chosen.count() <= SENT_ROWS  # 8 bytes each; beyond that the documents are shuffled
    model = train(rows.join(F.broadcast(chosen) if few else chosen, "doc_id", "left_semi"))
    scored = perplexities(rows, model)
    trusted = scored.join(good.filter(half == 1), "doc_id", "left_semi").filter("n_tokens > 0").select("lang", "log_sum", "n_tokens")
    every = trusted.agg(F.sum("log_sum") / F.sum("n_tokens")).first()[0] or 0.0
    means = {r["lang"]: r["m"] for r in trusted.groupBy("lang").agg((F.sum("log_sum") / F.sum("n_tokens")).alias("m"), F.count("*").alias("n")).filter(F.col("n") >= ENOUGH).collect()}

    def by_lang(values: dict, rest: float):
        out = F.lit(rest)
        for lang, v in values.items():
            if lang is not None:
                out = F.when(F.col("lang") == lang, v).otherwise(out)
        return out

    steady = F.exp(-(F.col("log_sum") + STEADY * by_lang(means, every)) / (F.col("n_tokens") + STEADY))
    trusted = written(trusted.select("lang", steady.alias("s")), "trusted")
    limits = _ranked(trusted, quantile, "lang").filter(F.col("n") >= ENOUGH).collect()
    rest = _ranked(trusted, quantile).first()
    rest = float("inf") if rest is None else rest["q"] * slack
    threshold = by_lang({r["lang"]: r["q"] * slack for r in limits}, rest)
    some = F.col("n_tokens") > 0
    out = scored.select("doc_id", "lang", "n_tokens", F.when(some, steady).alias("perplexity"), threshold.alias("threshold"), (some & (steady <= threshold)).alias("keep"))
    return written(out, "quality", keep=True)


def query(spark, sf_dir: str) -> DataFrame:
    """``op6_quality``: trusted are the documents with label quality 1."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
