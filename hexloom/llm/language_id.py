"""Language identification, word first with backoff to character n-grams.

A known word scores its log frequency in each language. An unseen word is cut into character n-grams, longest first
(five characters down to one): the first length of which any n-gram is known scores the word with the mean over its
known n-grams. A text's score is the sum over its words; the best language's posterior probability is the confidence.

``train`` is a classifier's fit: it reads at most about ``MAX_DOCS`` labelled rows, chosen by a hash of the id, as many
of each language (all of a language that has fewer), and keeps every word and n-gram of them. That bound is the only
one, so the model that goes to every task is bounded whatever the corpus. It is sparse: an entry costs 16 bytes and 8
more for each language that it occurs in, and languages that it doesn't occur in share one value by kind, so thousands
of values of ``lang`` do no harm. Prediction covers whole texts of all rows and shuffles nothing.

Defined cases: a text that is null, empty or without a letter is ``und`` with score 0; ties go to the language that
sorts first; rows without a language teach nothing, a language without counted entries is no answer, and with no
labelled row every text is ``und``; repeated rows each get a row; an empty table gives no rows. ``predict`` replaces
columns named ``lang_pred`` and ``lang_score``; the pipeline's stage adds none and keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import Words, bytes_of, gathered, mix, pieces, remainder, span_hash, stratified

MAX_DOCS, LONGEST, ADDED = 12_000, 5, 0.1
#: After lower-casing, words are runs of a-z and of bytes beyond ASCII.
_BREAKS = np.ones(256, bool)
_BREAKS[97:123] = _BREAKS[128:] = False


def _words(column: pa.Array) -> Words:
    raw, offsets = bytes_of(pc.utf8_lower(column.cast(pa.large_string())))
    return Words(raw, offsets, _BREAKS, lower=False)


def _grams(w: Words, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the given words, and the index of each one's word."""
    heads = np.append(np.flatnonzero((w.raw & 0xC0) != 0x80), len(w.raw))
    a, b = np.searchsorted(heads, start), np.searchsorted(heads, end)
    count = np.maximum(b - a - n + 1, 0)
    at = gathered(a, count)
    return mix(span_hash(w.prefix, heads[at], heads[at + n]) + np.uint64(n)), np.repeat(np.arange(len(start)), count)


@dataclass
class Model:
    """Sorted hashes of words and n-grams, the languages that each occurs in, and how much more than ``base`` (the log
    frequency of what does not occur, by kind and language) it scores there. Kind 0 is words, kind n is n-grams."""

    langs: list[str]
    keys: list[np.ndarray]
    first: list[np.ndarray]
    lang: list[np.ndarray]
    more: list[np.ndarray]
    base: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        w = _words(column)
        size = len(self.langs)
        word, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        # how often each distinct word stands in each text
        spot, times = np.unique(w.text_of() * max(1, len(word)) + which, return_counts=True)
        text, entry = spot // max(1, len(word)), spot % max(1, len(word))
        total = np.zeros(w.texts * size)
        left = np.arange(len(word))  # words that no kind has scored so far
        for kind in [0, *range(LONGEST, 0, -1)]:
            grams, of = (word[left], np.arange(len(left))) if kind == 0 else _grams(w, w.start[first[left]], w.end[first[left]], kind)
            at, known = _find(self.keys[kind], grams)
            at, of = at[known], of[known]
            hits = np.bincount(of, minlength=len(left))
            some = np.flatnonzero(hits)
            place = np.full(len(word), -1)
            place[left[some]] = some
            mine = np.flatnonzero(place[entry] >= 0)
            of_text, of_word, n = text[mine], place[entry[mine]], times[mine]
            total += (np.bincount(of_text, weights=n, minlength=w.texts)[:, None] * self.base[kind]).reshape(-1)
            order = np.argsort(of, kind="stable")
            at, begin = at[order], np.cumsum(hits) - hits
            for a in range(0, len(mine), 1 << 15):  # bounded steps: a word's n-grams times its texts
                x, y, m = of_text[a : a + (1 << 15)], of_word[a : a + (1 << 15)], n[a : a + (1 << 15)]
                gram = at[gathered(begin[y], hits[y])]
                row, weight = np.repeat(x, hits[y]), np.repeat(m / hits[y], hits[y])
                lo, count = self.first[kind][gram], np.diff(self.first[kind])[gram]
                spread = gathered(lo, count)
                total += np.bincount(np.repeat(row, count) * size + self.lang[kind][spread], weights=np.repeat(weight, count) * self.more[kind][spread], minlength=len(total))
            left = left[hits == 0]
            if not len(left):
                break
        total = total.reshape(w.texts, size)
        best = total.argmax(axis=1)
        sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        return [self.langs[b] if x else "und" for b, x in zip(best.tolist(), letter.tolist(), strict=True)], np.where(letter, sure, 0.0)


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


def train(df: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Learn from ``text`` and non-null ``lang`` of ``df``; ``doc_id`` only chooses the bounded sample."""
    rows = df.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per)
    rows = stratified(rows, "lang", max_docs, per)
    place = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w = _words(part.column("text"))
                lang = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)[w.text_of()]
                for kind, keys, langs_of in _kinds(w, lang):
                    for j in np.unique(langs_of):
                        key, n = np.unique(keys[langs_of == j], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(np.full(len(key), j, np.int32)), pa.array(n)], names=["kind", "key", "lang", "n"])

    def _kinds(w: Words, lang: np.ndarray):
        yield 0, w.hash, lang
        _, first = np.unique(mix(w.hash) + lang.astype(np.uint64), return_index=True)
        for n in range(1, LONGEST + 1):
            grams, of = _grams(w, w.start[first], w.end[first], n)
            yield n, grams, lang[first][of]

    counts = rows.select("text", "lang").mapInArrow(run, "kind int, key long, lang int, n long")
    got = counts.groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")).toArrow()  # entries of max_docs texts
    kind, lang, n = (got.column(c).to_numpy() for c in ("kind", "lang", "n"))
    key = got.column("key").to_numpy().view(np.uint64)
    # a language of which nothing was counted would win with its smoothed values for rare words
    some, lang = np.unique(lang, return_inverse=True)
    model = Model([langs[j] for j in some], [], [], [], [], np.zeros((LONGEST + 1, len(some))))
    for k in range(LONGEST + 1):
        own = np.flatnonzero(kind == k)
        own = own[np.lexsort((lang[own], key[own]))]
        keys, first = np.unique(key[own], return_index=True)
        model.keys.append(keys)
        model.first.append(np.append(first, len(own)))
        model.lang.append(lang[own].astype(np.int32))
        model.more.append(np.log(n[own] / ADDED + 1).astype(np.float32))
        sums = np.bincount(lang[own], weights=n[own], minlength=len(some))
        model.base[k] = np.log(ADDED / (sums + ADDED * max(1, len(keys))))
    return model


def predict(df: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df``, or all, with ``lang_pred`` and ``lang_score`` for each whole ``text``."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    own = ("lang_pred", "lang_score")
    schema = StructType([*[f for f in df.schema.fields if f.name not in own and (keep is None or f.name in keep)], StructField(own[0], StringType()), StructField(own[1], DoubleType())])
    names = [f.name for f in schema.fields[:-2]]
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in pieces(batch, "text"):
                pred, score = m.predict(part.column("text")) if m.langs else (["und"] * part.num_rows, np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(pred, pa.string()), pa.array(score)], names=[*names, *own])

    return df.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """``op3_language_id``: held out are the rows whose crc32 modulo 4 is 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(remainder("doc_id", 4) != 2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


#: A stage rejects texts without a language, and those whose best language has a posterior below this.
LEAST_SCORE = 0.5


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that have no language, or no clear one, go."""
    sent = spark.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in pieces(batch, "text"):
                if m.langs:
                    pred, score = m.predict(part.column("text"))
                    yield part.filter(pa.array((np.array(pred) != "und") & (score >= LEAST_SCORE)))

    return docs.mapInArrow(run, docs.schema)
