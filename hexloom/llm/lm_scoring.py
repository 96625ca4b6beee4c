"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model is an interpolated bigram model with a Dirichlet prior: P(z | y) = (c(y z) + M * P(z)) / (c(y) + M), where
P(z) = (c(z) + 1) / (N + V + 1) is the base. Its tries have two levels, contexts and their continuations; a leaf keeps
the logarithm of c(y z) / (c(y) + M) in 16 bits, and the rest of the formula is exact.

Plan. Whole texts are cut into chunks of about ``CHUNK_TOKENS`` tokens, kept once as compressed local word numbers in
a table bucketed by chunk (in the shared folder; the catalog knows it until the end, for the sake of the buckets, by
which answers meet chunks without a shuffle of these). A chunk asks for the count of each distinct word, then for the leaf of each distinct bigram;
questions travel as packed blobs to the shard of their hash, one for each shard that a chunk has questions for, are
summed, and answered in the same order. So a word or
bigram costs one entry a chunk however often it occurs, and what is gathered grows with the input. A shard builds its
trie from the training counts in its blobs, writes its levels to a scratch file of its task, maps that into memory,
and answers all questions by successor search inside the range that the pointers give for their context. A context that is more than ``SPLIT`` times as frequent as a trie should hold is
dealt to several shards by its continuations; no task ever gathers one word's whole neighbourhood.

Defined cases: a null text is the empty text, whose one token is the end; rows with a null id are scored and take part
in training by the crc32 of the empty text; repeated rows count as often as they occur; without training rows every
word is unknown and the base is 1 / (V + 1) with V = 0; an empty table gives no rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import Words, bytes_of, deleted, mix, pieces, remainder, scratch, shared_dir, written
from hexloom.llm.elias_fano import CHILD_BITS, Trie

U = np.uint64
CHUNK_TOKENS, SHARD_WORDS, SHARD_TOKENS, SPLIT, PRIOR = 1_000_000, 2_000_000, 2_000_000, 500_000, 60.0
END, BEGIN = mix(np.array([101], U))[0], mix(np.array([103], U))[0]
CODES, DECADES = 65_534, 12.0
CHUNK = "chunk long, doc_ids array<long>, held binary, lengths binary, vocab binary, tally binary, tokens binary"


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def pack40(a: np.ndarray) -> bytes:
    """The lower 40 bits of each value; hashes don't compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(U)


def code_of(share: np.ndarray) -> np.ndarray:
    """Quantised logarithms of shares in (0, 1]; 0 is for pairs that don't occur."""
    return (1 + np.rint(np.clip(-np.log10(share) / DECADES, 0, 1) * CODES)).astype(np.uint16)


def share_of(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10 ** (-(code.astype(np.float64) - 1) / CODES * DECADES), 0.0)


def _chunks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, held_out) as chunks of local word numbers; ``tally`` has training counts."""

    def flush(number: int, ids: list, held: list, lengths: list, hashes: list) -> pa.RecordBatch:
        h, n, out = np.concatenate(hashes), np.concatenate(lengths), np.concatenate(held)
        vocab, which = np.unique(h, return_inverse=True)
        tally = np.bincount(which[np.repeat(~out, n)], minlength=len(vocab)).astype(np.uint32)
        row = [number, [x for a in ids for x in a.to_pylist()], out.tobytes(), pack(n.astype(np.uint32)), vocab.tobytes(), pack(tally), pack(which.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5], strict=True)], names=["chunk", "doc_ids", "held", "lengths", "vocab", "tally", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            for part in pieces(batch, "text"):
                w = Words(*bytes_of(part.column("text")))
                n = np.diff(w.offsets) + 1
                h = np.insert(w.hash, w.offsets[1:], END)
                for own, new in zip(parts, (part.column("doc_id"), part.column("held_out").to_numpy(zero_copy_only=False), n, h), strict=True):
                    own.append(new)
                size += len(h)
                if size >= CHUNK_TOKENS:
                    yield flush(number, *parts)
                    number += 1
                    size = 0
                    for own in parts:
                        own.clear()
        if size:
            yield flush(number, *parts)

    return docs.mapInArrow(run, CHUNK)


def _ask_words(chunks: DataFrame, shards: int) -> DataFrame:
    """Per chunk and shard: the distinct words (in order of their hashes) and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, vocab, tally in zip(*(batch.column(c).to_pylist() for c in ("chunk", "vocab", "tally")), strict=True):
                vocab, tally = np.frombuffer(vocab, U), unpack(tally, np.uint32)
                shard = ((vocab >> U(32)) * U(shards) >> U(32)).astype(np.int64)
                own, begin = np.unique(shard, return_index=True)  # sorted, as the words are
                cut = list(zip(begin.tolist(), np.append(begin[1:], len(shard)).tolist(), strict=True))
                cols = [pa.array([chunk] * len(own)), pa.array(own, pa.int64()), pa.array([vocab[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([pack(tally[a:b]) for a, b in cut], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk", "shard", "words", "tally"])

    return chunks.select("chunk", "vocab", "tally").mapInArrow(run, "chunk long, shard long, words binary, tally binary")


def _answer_words(table: pa.Table) -> pa.Table:
    """Of one shard: each chunk's words' counts over all chunks; chunk -1 has (distinct, total) of training."""
    words = [np.frombuffer(x, U) for x in table.column("words").to_pylist()]
    tally = [unpack(x, np.uint32) for x in table.column("tally").to_pylist()]
    uniq, which = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(tally), minlength=len(uniq)).astype(np.int64)
    got = np.split(total[which], np.cumsum([len(w) for w in words])[:-1])
    sums = np.array([(total > 0).sum(), total.sum()], np.int64)
    shard = table.column("shard")[0].as_py()
    return pa.table({"chunk": [*table.column("chunk").to_pylist(), -1], "shard": [shard] * (len(got) + 1), "answer": pa.array([*map(pack, got), sums.tobytes()], pa.binary())})


class Chunk:
    """A chunk with the training counts of its words: tokens, and distinct bigrams in the order in which they are asked."""

    def __init__(self, row: dict, shards: int):
        self.doc_ids, self.held = row["doc_ids"], np.frombuffer(row["held"], bool)
        self.lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
        self.tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        vocab = np.frombuffer(row["vocab"], U)
        self.count = np.concatenate([unpack(a["answer"], np.int64) for a in sorted(row["counts"], key=lambda a: a["shard"])])
        self.of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        first = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        begin = len(vocab)  # a document's first token follows the mark of the beginning, as frequent as the end
        before[first] = begin
        at = min(int(np.searchsorted(vocab, END)), len(vocab) - 1)
        context_count = np.append(self.count, self.count[at] if vocab[at] == END else 0)
        key, self.which = np.unique(before * (begin + 1) + self.tokens, return_inverse=True)
        y, z = key // (begin + 1), key % (begin + 1)
        self.context_count = context_count[y]
        self.train = np.bincount(self.which[np.repeat(~self.held, self.lengths)], minlength=len(key))
        context, self.child = np.append(vocab, BEGIN)[y], mix(vocab[z] + U(1)) & U((1 << CHILD_BITS) - 1)
        parts = U(1) + self.context_count.astype(U) // U(SPLIT)
        shard = ((mix(context + (self.child % parts) * U(0x9E3779B97F4A7C15)) >> U(32)) * U(shards) >> U(32)).astype(np.int64)
        self.order = np.lexsort((self.child, context, shard))
        self.shard, self.context = shard[self.order], context[self.order]
        self.child, self.train, self.context_count = self.child[self.order], self.train[self.order], self.context_count[self.order]
        back = np.empty(len(key), np.int64)
        back[self.order] = np.arange(len(key))
        self.which = back[self.which]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _ask_pairs(joined: DataFrame, shards: int) -> DataFrame:
    """Per chunk and shard: the distinct bigrams by context, with training counts and the contexts' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                c = Chunk(row, shards)
                own, begin = np.unique(c.shard, return_index=True)
                out = []
                for k, a, b in zip(own.tolist(), begin.tolist(), np.append(begin[1:], len(c.shard)).tolist(), strict=True):
                    y = c.context[a:b]
                    first = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
                    out.append((row["chunk"], k, y[first].tobytes(), pack(np.diff(np.append(first, b - a)).astype(np.uint32)), pack(c.context_count[a:b][first].astype(np.int64)), pack40(c.child[a:b]), pack(c.train[a:b].astype(np.uint32))))
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["chunk", "shard", "contexts", "fan", "totals", "children", "train"])

    return joined.mapInArrow(run, "chunk long, shard long, contexts binary, fan binary, totals binary, children binary, train binary")


def _answer_pairs(table: pa.Table) -> pa.Table:
    """Of one shard: build the trie of all chunks' training counts, and look every chunk's bigrams up in it."""
    get = lambda c: table.column(c).to_pylist()
    fan = [unpack(x, np.uint32).astype(np.int64) for x in get("fan")]
    context = np.concatenate([np.repeat(np.frombuffer(x, U), f) for x, f in zip(get("contexts"), fan, strict=True)])
    total = np.concatenate([np.repeat(unpack(x, np.int64), f) for x, f in zip(get("totals"), fan, strict=True)])
    child = np.concatenate([unpack40(x) for x in get("children")])
    train = np.concatenate([unpack(x, np.uint32) for x in get("train")])
    sizes = [int(f.sum()) for f in fan]
    order = np.lexsort((child, context))
    new = np.ones(len(order), bool)
    new[1:] = (context[order][1:] != context[order][:-1]) | (child[order][1:] != child[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    count = np.bincount(which, weights=train, minlength=len(first))
    y, z = context[first], child[first]
    seen = count > 0
    trie = Trie.build(y[seen], z[seen], code_of(count[seen] / (total[first][seen] + PRIOR)))
    path = os.path.join(tempfile.gettempdir(), f"trie-{uuid.uuid4().hex}")
    try:
        trie.save(path)
        trie = Trie.load(path)
        codes = np.concatenate([trie.find(y[a : a + 200_000], z[a : a + 200_000]) for a in range(0, len(y), 200_000)])
    finally:
        os.unlink(path)
    got = np.split(codes[which], np.cumsum(sizes)[:-1])
    return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "answer": pa.array([pack(g) for g in got], pa.binary())})


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(joined: DataFrame, shards: int, tokens: int, distinct: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                c = Chunk(row, shards)
                code = np.concatenate([unpack(a["answer"], np.uint16) for a in sorted(row["leaves"], key=lambda a: a["shard"])])
                base = (c.count + 1) / (tokens + distinct + 1)
                n = len(c.lengths)
                back = PRIOR / (c.context_count + PRIOR)
                full = share_of(code)[c.which] + back[c.which] * base[c.tokens]
                sums = [np.bincount(c.of, weights=x, minlength=n) for x in (np.log10(base)[c.tokens], np.log10(np.minimum(full, 1.0)))]
                known = np.bincount(c.of, weights=c.count[c.tokens] > 0, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(c.held), pa.array(c.lengths), pa.array(known), pa.array(np.full(n, tokens)), *map(pa.array, sums)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return joined.mapInArrow(run, OUT)


def score(docs: DataFrame) -> DataFrame:
    """Score the whole texts of ``docs`` (doc_id, text, held_out) with a model of those that aren't held out."""
    with scratch():
        return _score(docs)


def _score(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    name = f"hexloom_chunks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    try:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        _chunks(docs.select("doc_id", "text", "held_out")).write.format("parquet").option("path", path).bucketBy(buckets, "chunk").saveAsTable(name)
        return _scored_chunks(spark.table(name))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        deleted(spark, path)


def _scored_chunks(chunks: DataFrame) -> DataFrame:
    spark = chunks.sparkSession
    size = chunks.agg(F.sum(F.octet_length("vocab")).alias("v"), F.sum(F.size("doc_ids")).alias("d"), F.sum(F.octet_length("tokens")).alias("t")).first()
    if not size["d"]:
        return spark.createDataFrame([], OUT)
    words, pairs = -(-size["v"] // 8 // SHARD_WORDS), -(-size["t"] // 2 // SHARD_TOKENS)
    answers = written(_ask_words(chunks, max(1, words)).groupBy("shard").applyInArrow(_answer_words, "chunk long, shard long, answer binary"), "counts")
    sums = np.sum([np.frombuffer(r["answer"], np.int64) for r in answers.filter("chunk = -1").select("answer").toLocalIterator()], axis=0)
    distinct, tokens = int(sums[0]), int(sums[1])
    by_chunk = lambda a, name: a.filter("chunk <> -1").groupBy("chunk").agg(F.collect_list(F.struct("shard", "answer")).alias(name))
    joined = chunks.select("chunk", "doc_ids", "held", "lengths", "vocab", "tokens").join(by_chunk(answers, "counts"), "chunk")
    asked = _ask_pairs(joined, max(1, pairs))
    leaves = written(asked.groupBy("shard").applyInArrow(_answer_pairs, "chunk long, shard long, answer binary"), "leaves")
    return written(_scored(joined.join(by_chunk(leaves, "leaves"), "chunk"), max(1, pairs), tokens, distinct), "scores", keep=True)


def query(spark, sf_dir: str) -> DataFrame:
    """``op10_lm_scoring``: held out are the rows whose crc32 modulo 7 is 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder("doc_id", 7) == 2).alias("held_out")))
