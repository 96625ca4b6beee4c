"""Line dedup by a deletion-neighbourhood join.

A line is its sequence of words (runs of other than ASCII white space, A-Z lower-cased). Two lines are alike if they
are equal or if one inserted, deleted or replaced word turns one into the other and the longer has ``NEAR_WORDS`` words
or more, of which one is a fifth: a similarity of 0.8. A line goes if an earlier line (by doc_id, then line number) is
alike; lines without words always stay.

Plan. Equal lines: one aggregate by a 128-bit hash keeps each line's first place; only these go on. Lines alike but
not equal share a run of words at the beginning or the end, so only distinct lines that share such a run with another
can have a partner: two counted keys a line find them (lossless, and no line's neighbourhood is built in vain). Keys of
many lines, as a common opening has, are sent to the lines instead of meeting them in one task. What is found emits all
variants with one word deleted, and itself, as hashed keys. Keys travel as packed blobs by bucket; a task sends only the
earliest line of each key, since all others in it are settled by that one. Equal variants are joined in the bucket, and
every pair that would drop a line is verified on the words themselves.

What goes to all tasks is lists of line numbers by document, and only while they stay under ``SENT_ROWS`` documents
and ``SENT_LINES`` lines; beyond that the documents are shuffled by id instead.

Defined cases: a null text stays null and has no lines, the empty text has one line without words; rows with a null id
come after all others; rows that share an id, or have none, and differ in text are documents of their own, in the order
of a hash of the text, and equal rows are one document, whose lines stay in each of them; copies within a document go
like others; an empty table gives no rows. Further columns of the input are kept by ``dedup``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import Words, bytes_of, gathered, mix, pieces, scratch, written

U = np.uint64
NEAR_WORDS, BUCKET_LINES, FLUSH_KEYS = 5, 20_000, 1_000_000
SENT_ROWS, SENT_LINES, HOT_LINES = 500_000, 4_000_000, 10_000
LAST = (1 << 63) - 1
_B1, _B2 = U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93 | 1)
_I1 = U(pow(int(_B1), -1, 1 << 64))


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of all lines of some texts, each line's text, and its number in it."""
    ends = np.flatnonzero(raw == 10)
    text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, ends, "right") - 1])
    start = np.concatenate([offsets[:-1], ends + 1])
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    first = np.searchsorted(text, np.arange(len(offsets) - 1))
    return np.append(start, len(raw)), text, np.arange(len(text)) - first[text]


class Sequences:
    """Prefix sums over the words' hashes, from which any run of words, and a run without one word, is hashed."""

    def __init__(self, words: np.ndarray, base: np.uint64 = _B1, inverse: np.uint64 = _I1):
        self.up = np.ones(len(words) + 1, U)
        np.multiply.accumulate(np.full(len(words), base), out=self.up[1:])
        self.down = np.ones(len(words) + 1, U)
        np.multiply.accumulate(np.full(len(words), inverse), out=self.down[1:])
        self.inverse = inverse
        self.sums = np.zeros(len(words) + 1, U)
        np.cumsum(words * self.up[:-1], out=self.sums[1:])

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(U))

    def without(self, a: np.ndarray, p: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of the run [a, b) without the word at p, equal to that of the same words in a run of their own."""
        rest = self.sums[p] - self.sums[a] + (self.sums[b] - self.sums[p + 1]) * self.inverse
        return mix(rest * self.down[a] + (b - a - 1).astype(U))


def half_of(n: np.ndarray) -> np.ndarray:
    """A number of words that lines of ``n`` words share at an end with any that is alike: less than half of the words,
    the same for many lengths."""
    return np.where(n < 8, 2, 4 * (n // 8))


def _scan(docs: DataFrame) -> DataFrame:
    """Every line with words: 128-bit hash, place, and up to four keys of its halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                raw, offsets = bytes_of(part.column("text"))
                at, text, number = lines_of(raw, offsets)
                w = Words(raw, at)
                a, b = w.offsets[:-1], w.offsets[1:]
                some = b > a
                a, b, text, number = a[some], b[some], text[some], number[some]
                s = Sequences(w.hash)
                other = mix(w.hash + _B2)
                second = np.add.reduceat(other * (np.arange(len(other), dtype=U) - np.repeat(a, b - a).astype(U)) * _B2 + mix(other), a) if len(a) else other
                n = b - a
                keys = []
                for extra in (0, 1):
                    half = np.minimum(half_of(n - extra), n)  # one word less may be below a step
                    good = (n >= NEAR_WORDS - 1) & ((n % 8 == 0) if extra else True)
                    for side, (x, y) in enumerate(((a, a + half), (b - half, b))):
                        keys.append(pa.array(mix(s.run(x, y) + U(side + 1)).view(np.int64), mask=~good))
                doc, row = (part.column(c).take(pa.array(text)) for c in ("doc_id", "row"))
                yield pa.RecordBatch.from_arrays([pa.array(s.run(a, b).view(np.int64)), pa.array(mix(second).view(np.int64)), doc, row, pa.array(number.astype(np.int32)), *keys], names=["h1", "h2", "doc", "row", "line", "k0", "k1", "k2", "k3"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc long, row long, line int, k0 long, k1 long, k2 long, k3 long")


def _picked(docs: DataFrame, wanted: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` joined with ``wanted`` (doc_id, row, lines): sent to all tasks while small, shuffled otherwise."""
    total = wanted.agg(F.count("*").alias("n"), F.sum(F.size("lines")).alias("lines")).first()
    few = total["n"] <= SENT_ROWS and (total["lines"] or 0) <= SENT_LINES
    return docs.join(F.broadcast(wanted) if few else wanted, ["doc_id", "row"], how)


def _chosen(batch: pa.RecordBatch) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that ``lines`` names: bytes, words, ranges of lines, index of each wanted line, and its document."""
    raw, offsets = bytes_of(batch.column("text"))
    at, text, _ = lines_of(raw, offsets)
    wanted = batch.column("lines")
    owner = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
    first = np.searchsorted(text, np.arange(batch.num_rows))
    number = wanted.flatten().to_numpy(zero_copy_only=False)
    return raw, Words(raw, at), at, first[owner] + number, owner


def _variants(found: DataFrame, buckets: int) -> DataFrame:
    """Packed (key, deleted position, document, line) by bucket; position -1 is the line itself. ``settled`` holds
    (document, line, earlier document, earlier line) of lines that this task's own lines already settle."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        key, place, *at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((*at[::-1], place, key))
        key, place, at = key[order], place[order], [x[order] for x in at]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        later = np.flatnonzero(~new & np.any([x != x[lead] for x in at], axis=0))
        settled = np.stack([x[later] for x in at] + [x[lead[later]] for x in at], axis=1).astype(np.int64)
        key, place, at = key[new], place[new], [x[new] for x in at]
        bucket = (key >> U(32)) * U(buckets) >> U(32)
        present, begin = np.unique(bucket, return_index=True)  # sorted, as the keys are
        cut = list(zip(begin.tolist(), np.append(begin[1:], len(key)).tolist(), strict=True))
        home = mix(settled[:, 0].astype(U)) % U(len(present)) if len(present) else np.zeros(0, U)
        cols = [[x[a:b].tobytes() for a, b in cut] for x in (key, place, *at)]
        own = [settled[home == U(k)].tobytes() for k in range(len(present))]
        yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int64)), *[pa.array(c, pa.binary()) for c in (*cols, own)]], names=["bucket", "keys", "places", "docs", "texts", "lines", "settled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch, "text"):
                _, w, _, at, owner = _chosen(part)
                doc, row = (part.column(c).to_numpy()[owner] for c in ("doc_id", "row"))
                line = part.column("lines").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                a, b = w.offsets[at], w.offsets[at + 1]
                n = np.where(b - a < NEAR_WORDS, 0, b - a)  # shorter lines are only what longer ones may turn into
                s = Sequences(w.hash)
                of = np.repeat(np.arange(len(a)), n)
                p = gathered(a, n)
                keys = np.concatenate([s.run(a, b), s.without(a[of], p, b[of])])
                place = np.concatenate([np.full(len(a), -1), p - a[of]]).astype(np.int32)
                held.append((keys, place, *(np.concatenate([x, x[of]]) for x in (doc, row, line))))
                size += len(keys)
                if size > FLUSH_KEYS:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return found.select("doc_id", "row", "text", "lines").mapInArrow(run, "bucket long, keys binary, places binary, docs binary, texts binary, lines binary, settled binary")


PLACE = "doc long, row long, line int"
BOTH = f"{PLACE}, doc0 long, row0 long, line0 int"


def _equal(table: pa.Table) -> pa.Table:
    """Of one bucket: each line that shares a variant with an earlier one, and that one."""
    key, place, *at = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", U), ("places", np.int32), ("docs", np.int64), ("texts", np.int64), ("lines", np.int32)))
    rows = [np.frombuffer(b"".join(table.column("settled").to_pylist()), np.int64).reshape(-1, 6)]
    order = np.lexsort((*at[::-1], place, key))
    key, place, (doc, row, line) = key[order], place[order], (x[order] for x in at)

    def pair(who: np.ndarray, lead: np.ndarray) -> None:
        same_row = (row[lead] < row[who]) | (row[lead] == row[who]) & (line[lead] < line[who])
        good = (doc[lead] < doc[who]) | (doc[lead] == doc[who]) & same_row
        who, lead = who[good], lead[good]
        rows.append(np.stack([x[y] for y in (who, lead) for x in (doc, row, line)], axis=1).astype(np.int64))

    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    pair(np.flatnonzero(~new), lead[~new])  # one word replaced by another
    whole = np.flatnonzero(new & (place < 0))  # the earliest whole line of a key, and the earliest that lacks a word
    part = np.flatnonzero(place >= 0)
    part = part[np.lexsort((line[part], row[part], doc[part], key[part]))]
    first = np.ones(len(part), bool)
    first[1:] = key[part][1:] != key[part][:-1]
    if len(whole) and len(part):
        near = np.minimum(np.searchsorted(key[whole], key[part]), len(whole) - 1)
        hit = key[whole][near] == key[part]
        pair(part[hit], whole[near[hit]])
        firsts = part[first]
        every = np.flatnonzero(place < 0)
        near = np.minimum(np.searchsorted(key[firsts], key[every]), len(firsts) - 1)
        hit = key[firsts][near] == key[every]
        pair(every[hit], firsts[near[hit]])
    out = np.concatenate(rows)
    return pa.table({n: out[:, k].astype(np.int32) if n.startswith("line") else out[:, k] for k, n in enumerate(("doc", "row", "line", "doc0", "row0", "line0"))})


def alike(a: list, b: list) -> bool:
    """Whether at most one inserted, deleted or replaced word turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, longest = min(len(a), len(b)), max(len(a), len(b))
    p = 0
    while p < short and a[p] == b[p]:
        p += 1
    s = 0
    while s < short - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= longest - 1


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose words are alike indeed."""
    ends = pairs.select("doc", "row", "line").unionByName(pairs.select(F.col("doc0").alias("doc"), F.col("row0").alias("row"), F.col("line0").alias("line")))
    wanted = written(_by_document(ends, F.collect_set), "wanted")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                _, w, lines, at, owner = _chosen(part)
                whole = w.raw.tobytes()
                raw = [whole[x:y] for x, y in zip(lines[at].tolist(), lines[at + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(owner)) for c in ("doc_id", "row")), part.column("lines").flatten(), pa.array(raw, pa.binary())], names=["doc", "row", "line", "words"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(x.split(), y.split()) for x, y in zip(batch.column("words").to_pylist(), batch.column("words0").to_pylist(), strict=True)]
            yield batch.select(["doc", "row", "line"]).filter(pa.array(keep, pa.bool_()))

    text = written(_picked(docs, wanted).select("doc_id", "row", "text", "lines").mapInArrow(words, f"{PLACE}, words binary").dropDuplicates(["doc", "row", "line"]), "words")
    first = text.select(*(F.col(c).alias(f"{c}0") for c in ("doc", "row", "line", "words")))
    both = pairs.join(text, ["doc", "row", "line"]).join(first, ["doc0", "row0", "line0"])
    return both.select("doc", "row", "line", "words", "words0").mapInArrow(check, PLACE).distinct()


def _by_document(places: DataFrame, collect) -> DataFrame:
    """(doc_id, row, lines) of rows (doc, row, line)."""
    return places.groupBy("doc", "row").agg(F.array_sort(collect("line")).alias("lines")).withColumnRenamed("doc", "doc_id")


def _identified(docs: DataFrame, *others) -> DataFrame:
    """``doc_id`` (nulls last), a hash of the text that tells rows of one id apart, and other columns."""
    return docs.select(*others, F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("row"))


def kept_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, lines): the numbers of the lines with words that stay, for each document that keeps any."""
    with scratch():
        return written(_kept_lines(docs), "kept", keep=True)


def _shared(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose key another line has, too."""
    count = written(keys.groupBy("key").count().filter("count > 1"), "shared")
    hot = count.filter(F.col("count") > HOT_LINES).select("key")
    if not 0 < hot.count() <= SENT_ROWS:  # 8 bytes each
        return keys.join(count.select("key"), "key", "left_semi")
    hot = F.broadcast(hot)
    return keys.join(hot, "key", "left_semi").unionByName(keys.join(hot, "key", "left_anti").join(count.select("key"), "key", "left_semi"))


def _kept_lines(docs: DataFrame) -> DataFrame:
    docs = _identified(docs, docs["text"].cast("string").alias("text"))
    halves = F.array_compact(F.array_distinct(F.array("f.k0", "f.k1", "f.k2", "f.k3")))
    first = _scan(docs).groupBy("h1", "h2").agg(F.min(F.struct("doc", "row", "line", "k0", "k1", "k2", "k3")).alias("f"))
    first = written(first.select("f.doc", "f.row", "f.line", halves.alias("keys")), "lines")
    keys = first.select("doc", "row", "line", F.explode("keys").alias("key"))
    near = written(_by_document(_shared(keys), F.collect_set), "near")
    size = near.agg(F.sum(F.size("lines"))).first()[0]
    kept = first.select("doc", "row", "line")
    if size:
        blobs = _variants(_picked(docs, near), max(1, -(-size // BUCKET_LINES)))
        pairs = blobs.groupBy("bucket").applyInArrow(_equal, BOTH)
        kept = kept.join(_verified(written(pairs.distinct(), "pairs"), docs), ["doc", "row", "line"], "left_anti")
    return _by_document(kept, F.collect_list)


def _rewritten(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, str | None, int, int]]:
    """(lines, kept text, kept lines, lines with words that were kept) of each document."""
    raw, offsets = bytes_of(batch.column(column))
    at, text, number = lines_of(raw, offsets)
    w = Words(raw, at)
    empty = np.diff(w.offsets) == 0
    whole = raw.tobytes()
    first = np.searchsorted(text, np.arange(batch.num_rows + 1))
    for k, (t, lines) in enumerate(zip(batch.column(column).is_null().to_pylist(), batch.column("lines").to_pylist(), strict=True)):
        if t:
            yield 0, None, 0, 0
            continue
        a, b = int(first[k]), int(first[k + 1])
        stay = empty[a:b].copy()
        stay[lines or []] = True
        own = [whole[at[i] : (at[i + 1] - 1 if i + 1 < b else offsets[k + 1])] for i in (np.flatnonzero(stay) + a).tolist()]
        yield b - a, b"\n".join(own).decode(), len(own), len(lines or [])


def _with_lines(df: DataFrame) -> DataFrame:
    """The columns of ``df`` by position (c0, c1, ...), whatever their names, and ``lines``."""
    kept = kept_lines(df)
    own = [df[c].alias(f"c{k}") for k, c in enumerate(df.columns)]
    return _picked(_identified(df, *own), kept, "left").drop("doc_id", "row")


def dedup(df: DataFrame) -> DataFrame:
    """``df`` with the repeated lines taken out of ``text`` (and ``n_chars`` renewed, where there is one).

    Documents of which no line with words is left, though they had some, go.
    """
    joined = _with_lines(df)
    schema, names = df.schema, df.columns
    text = f"c{names.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                got = list(_rewritten(part, text))
                had = np.array([bool(t and t.strip(" \t\n\r\f\v")) for t in part.column(text).to_pylist()])
                stay = np.array([g[3] > 0 for g in got]) | ~had
                new = pa.array([g[1] for g in got], pa.string())
                chars = pa.array([None if g[1] is None else len(g[1]) for g in got], pa.int64())
                cols = [new if n == "text" else chars.cast(part.column(f"c{k}").type) if n == "n_chars" else part.column(f"c{k}") for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(stay))

    return joined.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """``op5_line_dedup``: per document the number of lines and of kept ones, and length and digest of what is kept."""
    joined = _with_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "c1"):
                lines, text, kept, _ = zip(*_rewritten(part, "c1"), strict=True)
                digest = [None if t is None else hashlib.md5(t.encode()).hexdigest() for t in text]
                chars = [None if t is None else len(t) for t in text]
                yield pa.RecordBatch.from_arrays([part.column("c0"), pa.array(lines), pa.array(kept), pa.array(chars, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_lines", "n_kept", "kept_chars", "kept_md5"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_kept long, kept_chars long, kept_md5 string")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: repeated lines go, and documents of which nothing is left."""
    return dedup(docs)


SQL = r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS raw FROM cut),
seqs AS (SELECT doc_id, line, raw, regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM lines),
firsts AS (SELECT w, len(w) AS n, min({'d': doc_id, 'l': line}) AS place FROM seqs WHERE len(w) > 0 GROUP BY w),
places AS (SELECT place, w, n, unnest(range(-1, CASE WHEN n >= 5 THEN n ELSE 0 END)) AS p FROM firsts WHERE n >= 4),
variants AS (SELECT place, p, md5(array_to_string(CASE WHEN p < 0 THEN w ELSE list_concat(w[1:p], w[p + 2:]) END, ' ')) AS key FROM places),
gone AS (
  SELECT a.place FROM variants a JOIN (SELECT key, p, min(place) AS low FROM variants GROUP BY ALL) b USING (key, p) WHERE b.low < a.place
  UNION SELECT a.place FROM variants a JOIN (SELECT key, min(place) AS low FROM variants WHERE p < 0 GROUP BY key) b USING (key) WHERE a.p >= 0 AND b.low < a.place
  UNION SELECT a.place FROM variants a JOIN (SELECT key, min(place) AS low FROM variants WHERE p >= 0 GROUP BY key) b USING (key) WHERE a.p < 0 AND b.low < a.place),
kept AS (SELECT place.d AS doc_id, place.l AS line FROM firsts WHERE place NOT IN (SELECT place FROM gone)),
stay AS (
  SELECT s.doc_id, s.line, s.raw, len(s.w) = 0 OR k.line IS NOT NULL AS stays FROM seqs s LEFT JOIN kept k ON k.doc_id = s.doc_id AND k.line = s.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (stays) AS n_kept,
  CAST(length(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (stays), '')) AS BIGINT) AS kept_chars,
  md5(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (stays), '')) AS kept_md5
FROM stay GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL, NULL FROM documents WHERE text IS NULL
"""
