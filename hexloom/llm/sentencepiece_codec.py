"""Encoding and decoding with a SentencePiece model on the tokenizers library.

``parse`` reads the model's protobuf itself. ``backend`` rebuilds the model for the tokenizers library: the normaliser
(character map, extra spaces, dummy prefix, metaspace marker), the pieces with their scores (unigram, or BPE with
merges in the order of the scores) and byte fallback. ``Codec`` encodes batches on several threads and decodes by
gathering the pieces' bytes. ``parity`` compares all with the sentencepiece library itself.

Only normal and user-defined pieces may match a text. Under a unigram model the others stand in the library's
vocabulary under names that no text is likely to hold, and unknown characters are cut into byte pieces here. Texts of a
model with user-defined symbols are normalised here, around the symbols, since the prefix stands before a symbol, too.

The model's file is read where the plan is made, and its bytes travel with the tasks: executors need no copy of it.

Where no piece holds a marker after another character and the normaliser only escapes spaces, no piece can span the
start of a run of spaces. Texts are then cut there, and a segment that occurs again in a batch is encoded once.

Defined cases: a null text has null ids, the empty text none; texts of any length are encoded whole; control pieces'
strings inside a text are ordinary text; repeated rows are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import bytes_of, gathered, mix, pieces, prefix_hash, span_hash

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
BATCH = 8192


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        wire = key & 7
        if wire == 0:
            value: int | bytes = number()
        else:
            size = {1: 8, 5: 4}[wire] if wire != 2 else number()
            value = data[at : at + size]
            at += size
        yield key >> 3, value


def file_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse(data: bytes) -> Model:
    """Pieces, trainer and normaliser specifications of a model file."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            m.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.remove_extra, m.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return m


def normaliser(m: Model, prefix: bool = True):
    """The tokenizers library's twin of the model's normaliser. ``prefix``: put the dummy prefix before each text."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A | \z"), "")]
    if m.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def backend(m: Model):
    """The tokenizers library's twin of the model, without a normaliser."""
    from tokenizers import AddedToken, Tokenizer, models

    unk = next((k for k, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
    if m.kind == UNIGRAM:
        # ids are places in the list, so pieces that mustn't match keep their place under another name
        model = models.Unigram([(p if t in (NORMAL, USER) else f"\U0010FFFE{k}\U0010FFFF", s) for k, (p, s, t) in enumerate(m.pieces)], unk, byte_fallback=False)
    elif m.kind == BPE:
        vocab = {p: k for k, (p, _, _) in enumerate(m.pieces)}
        part = {p for p, _, t in m.pieces if t in (NORMAL, USER)}
        ranked = []
        for k, (p, score, t) in enumerate(m.pieces):
            if t == NORMAL and len(p) > 1:
                ranked += [(-score, k, vocab[p[:c]], p[:c], p[c:]) for c in range(1, len(p)) if p[:c] in part and p[c:] in part]
        ranked.sort()
        model = models.BPE(vocab, [(a, b) for *_, a, b in ranked], unk_token=m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    tok = Tokenizer(model)
    tok.add_tokens([AddedToken(p, normalized=False) for p, _, t in m.pieces if t == USER])
    return tok


class Codec:
    """Encoder and decoder of whole batches."""

    def __init__(self, data: bytes, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.model = m = parse(data)
        symbols = sorted((p for p, _, t in m.pieces if t == USER), key=len, reverse=True)
        self.symbols = re.compile("(" + "|".join(map(re.escape, symbols)) + ")") if symbols else None
        plain = not m.charsmap and not m.remove_extra and m.escape and not symbols
        self.segments = plain and not any(MARK in p.lstrip(MARK) for p, _, t in m.pieces if t == NORMAL)
        self.tok = backend(m)
        if not symbols:
            self.tok.normalizer = normaliser(m, prefix=not self.segments)
        elif m.charsmap:
            from tokenizers import normalizers

            self.chars = normalizers.Precompiled(m.charsmap)
        self.unknown = next((k for k, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
        of_byte = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(m.pieces) if t == BYTE}
        self.of_byte = of_byte if m.kind == UNIGRAM and m.byte_fallback and len(of_byte) == 256 else None
        raw = []
        for p, _, t in m.pieces:
            raw.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode())
        self.size = np.array([len(r) for r in raw], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _normal(self, text: str) -> str:
        """A text of a model with symbols, normalised around these."""
        m = self.model
        if m.charsmap:
            parts = self.symbols.split(text)
            parts[::2] = [self.chars.normalize_str(p) for p in parts[::2]]
            text = "".join(parts)
        if m.remove_extra:
            text = re.sub(" {2,}", " ", text).strip(" ")
        if m.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if m.escape else text

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and each one's number of ids."""
        if self.symbols is not None:
            texts = [self._normal(t) for t in texts]
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a in range(0, len(texts), BATCH):  # what the library returns takes far more memory than the ids
            some = texts[a : a + BATCH]
            got = [e.ids for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]
            if self.of_byte is not None:
                odd = [k for k, ids in enumerate(got) if self.unknown in ids]
                for k, e in zip(odd, self.tok.encode_batch([some[k] for k in odd], add_special_tokens=False), strict=True):
                    got[k] = [x for i, t in zip(e.ids, e.tokens, strict=True) for x in ([self.of_byte[b] for b in t.encode()] if i == self.unknown else [i])]
            n = np.fromiter(map(len, got), np.int64, len(got))
            sizes.append(n)
            parts.append(np.fromiter((i for ids in got for i in ids), np.int32, int(n.sum())))
        return np.concatenate(parts), np.concatenate(sizes)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column and offsets of each text's ids."""
        # a marker that stands in a text means a space, as everywhere in this format
        raw, offsets = bytes_of(pc.replace_substring(column, MARK, " ") if self.segments else column)
        if not self.segments:
            ids, n = self._ids(["" if t is None else t for t in column.to_pylist()])
            return ids, np.concatenate([[0], np.cumsum(n)])
        full = np.diff(offsets) > 0
        if not full.any():
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.model.dummy_prefix:
            raw = np.insert(raw, offsets[:-1][full], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        head = raw == 32
        head[1:] &= raw[:-1] != 32
        head[offsets[:-1][full]] = True
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(raw))
        key = span_hash(prefix_hash(raw), start, end)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        whole = raw.tobytes()
        ids, n = self._ids([whole[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        count = n[which]
        out = ids[gathered(begin[which], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        return out, total[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text, without the dummy prefix."""
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        whole = self.raw[gathered(self.at[ids], size)].tobytes()
        cut = total[offsets]
        drop = self.model.dummy_prefix
        return [whole[a + 1 : b] if drop and whole[a : a + 1] == b" " else whole[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def decode_text(self, ids: list[int]) -> str:
        """One text; bytes that are no UTF-8 become replacement characters."""
        a = np.asarray(ids, np.int64)
        return self.decode(a, np.array([0, len(a)]))[0].decode(errors="replace")


@lru_cache(maxsize=2)
def codec(data: bytes | None = None, threads: int = 2) -> Codec:
    """One codec of a model file's bytes for each Python worker."""
    return Codec(file_bytes() if data is None else data, threads)


def _sent(df: DataFrame, path: str):
    """The model file's bytes, on their way to the tasks: some 10 bytes a piece."""
    return df.sparkSession.sparkContext.broadcast(file_bytes(path))


def parity(texts: list[str], path: str = MODEL) -> list[int]:
    """Positions of texts for which this codec and the sentencepiece library differ in ids or decoded text."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    ours = codec(file_bytes(path))
    ids, offsets = ours.encode(pa.array(texts, pa.string()))
    back = ours.decode(ids, offsets)
    bad = []
    for k, text in enumerate(texts):
        own, want = ids[offsets[k] : offsets[k + 1]].tolist(), theirs.encode(text)
        if own != want or back[k].decode(errors="replace") != theirs.decode(want):
            bad.append(k)
    return bad


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", path: str = MODEL, threads: int = 2) -> DataFrame:
    """All columns of ``df`` and the ids of ``text`` as array<int>."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([*[f for f in df.schema.fields if f.name != ids], StructField(ids, ArrayType(IntegerType()))])
    names = [f.name for f in schema.fields[:-1]]
    sent = _sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, threads)
        for batch in batches:
            for part in pieces(batch, text):
                out, offsets = c.encode(part.column(text))
                null = np.asarray(part.column(text).is_null())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], lists], names=[*names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "token_ids", text: str = "decoded", path: str = MODEL) -> DataFrame:
    """All columns of ``df`` and the text that the ids stand for."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*[f for f in df.schema.fields if f.name != text], StructField(text, StringType())])
    names = [f.name for f in schema.fields[:-1]]
    sent = _sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(ids)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                size = np.asarray(column.value_lengths().fill_null(0))
                back = c.decode(flat, np.concatenate([[0], np.cumsum(size)]))
                null = np.asarray(column.is_null())
                texts = pa.array([None if x else b.decode(errors="replace") for b, x in zip(back, null.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], texts], names=[*names, text])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str = MODEL, threads: int = 2) -> DataFrame:
    """Per document: number of ids, those of byte pieces, a 64-bit digest of the id sequence, and whether decoding
    gives the text back."""
    sent = _sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, threads)
        is_byte = np.array([t == BYTE for *_, t in c.model.pieces])
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, offsets = c.encode(part.column("text"))
                raw, at = bytes_of(part.column("text"))
                whole = raw.tobytes()
                back = c.decode(ids, offsets)
                same = [whole[a:b] == x for a, b, x in zip(at[:-1].tolist(), at[1:].tolist(), back, strict=True)]
                n = np.diff(offsets)
                place = (np.arange(len(ids)) - np.repeat(offsets[:-1], n)).astype(np.uint64)
                sums = np.concatenate([[0], np.cumsum(mix((place << np.uint64(20)) + ids.astype(np.uint64) + np.uint64(1)))]).astype(np.uint64)
                marks = np.concatenate([[0], np.cumsum(is_byte[ids])])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(marks[offsets[1:]] - marks[offsets[:-1]]), pa.array((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)), pa.array(same)],
                    names=["doc_id", "n_tokens", "n_byte_tokens", "ids_digest", "round_trip"],
                )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_digest long, round_trip boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """``op1_sentencepiece``: every whole document, encoded and decoded."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the documents with their ids."""
    return encode(docs)
