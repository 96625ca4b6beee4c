"""Toxicity by Levenshtein automata intersected with a lexicon trie, weighed by context windows.

``train`` learns a lexicon from labelled rows: whole words that occur almost only in toxic documents, and families, the
words with a common beginning (of 4 to 7 characters) that mostly occur in toxic ones. Both are chosen by greedy cover, so
that a word which merely keeps company with a chosen term adds nothing; of a chosen family all words that mostly occur in
toxic documents become terms, and the beginning itself is no term. The terms form tries of ``TRIE_TERMS`` at most; the
product of a trie with the Levenshtein automata of its terms (one edit from five bytes on, two from nine, but one for
words of families; the first byte must match) is determinised once, into a table of transitions. All distinct words of a
chunk walk these tables together; words without a hit, and words with digits or symbols in them, walk a second kind, in
which the first byte may be edited too. What is a word of its own in the labelled rows, mostly in documents that aren't
toxic, is no misspelling.

A hit is a term, a misspelled term, a word of a family or its misspelling, or a hit of the second walk, and quoted or
not: within ``WINDOW`` words it stands between quotation marks, or one of the words ``reports`` (a parameter) stands by.
These counts, and how dense words of families are, feed a logistic regression, which learns what each kind of hit is
worth; ``Model.support`` has the labelled documents with each kind of hit, of both labels. A kind that the labelled rows
hardly show keeps the weight that ``PRIOR`` gives it.

Bounds. A fit reads at most about ``MAX_DOCS`` labelled rows, chosen by a hash of the id; every word of these counts,
and only the model goes to all tasks. A term or a family is chosen while it covers ``LEAST_SHARE`` of the toxic rows that
no other covers. Scoring covers whole texts of all rows and shuffles nothing. Edits are counted in bytes of UTF-8.

Defined cases: null and empty texts score like a text without hits; of labels that share an id the largest counts;
labels that are null or belong to no document teach nothing; without labels of both kinds every score is 0; repeated
rows are scored alike; an empty table gives no rows; a column named ``score`` is replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import Words, bytes_of, pieces, remainder, scratch, span_hash, written

MAX_DOCS, TRIE_TERMS, WINDOW, PURE, PURE_STEM, LEAST_GAIN, LEAST_SHARE = 12_000, 32, 6, 0.9, 0.5, 2, 0.002
STEMS = (4, 5, 6, 7)
QUOTES = '"“”„«»‹›'
REPORTS = ("said", "says", "wrote", "writes", "quoted", "quote", "called", "calls", "word", "term", "sagte", "schrieb", "nannte", "wort", "dit", "écrit", "appelé", "mot", "dijo", "escribió", "llamó", "palabra")
_BREAKS = np.ones(256, bool)
_BREAKS[97:123] = _BREAKS[128:] = False
_QUOTE = "".join(QUOTES)
#: Of disguised words only white space, control characters and the (now ASCII) quotation mark are the ends.
_ENDS = np.zeros(256, bool)
_ENDS[:33] = _ENDS[[34, 127]] = True
_SIGNS = _BREAKS & ~_ENDS


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets in lower case; quotation marks, which are bytes beyond ASCII, are made ASCII."""
    low = pc.utf8_lower(column.cast(pa.large_string()))
    for q in _QUOTE[1:]:
        low = pc.replace_substring(low, q, '"')
    return bytes_of(low)


def words_of(column: pa.Array) -> Words:
    """Runs of letters."""
    return Words(*_lowered(column), _BREAKS, lower=False)


def disguised(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of words that hold digits or symbols, without the symbols around them."""
    wide = Words(raw, offsets, _ENDS, lower=False)
    solid = np.flatnonzero(~_BREAKS[raw] | (raw >= 48) & (raw <= 57))
    a, b = np.searchsorted(solid, wide.start), np.searchsorted(solid, wide.end)
    a, b = a[a < b], b[a < b]
    start, end = solid[a], solid[b - 1] + 1
    signs = np.concatenate([[0], np.cumsum(_SIGNS[raw])])
    n = signs[end] - signs[start]
    mixed = (n > 0) & (n < end - start)
    return start[mixed], end[mixed]


def tolerance(term: bytes) -> int:
    """Edits that a misspelling of a whole word may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


#: Results of a walk, the better ones first; the last is of the second walk.
TERM, WORD, NEAR_TERM, NEAR_WORD, LOOSE = range(1, 6)


class Automaton:
    """The determinised product of a lexicon trie with Levenshtein automata; ``words`` are those of families. A walk gives
    0 (no hit), ``TERM``, ``WORD``, ``NEAR_TERM`` or ``NEAR_WORD``. With ``root`` the first byte may be edited, too."""

    def __init__(self, terms: list[str], words: list[str], root: bool = False):
        child: list[dict[int, int]] = [{}]
        end: dict[int, tuple[int, int]] = {}
        reach: list[int] = [0]

        def insert(raw: bytes, most: int) -> int:
            node = 0
            for b in raw:
                if b not in child[node]:
                    child[node][b] = len(child)
                    child.append({})
                    reach.append(0)
                node = child[node][b]
                reach[node] = max(reach[node], most)
            return node

        for kind, own in ((WORD, words), (TERM, terms)):
            for t in own:
                most = tolerance(t.encode()) if kind == TERM else min(1, tolerance(t.encode()))
                end[insert(t.encode(), most)] = (most, kind)
        reach[0] = max(reach) if root else 0

        def closed(items: set[tuple[int, int]]) -> frozenset:
            todo, best = list(items), {}
            while todo:
                node, e = todo.pop()
                if e > reach[node] and (node or root) or best.get(node, 99) <= e:
                    continue
                best[node] = e
                if node or root:
                    todo += [(c, e + 1) for c in child[node].values()]
            return frozenset(best.items())

        bytes_used = sorted({b for c in child for b in c})
        self.classes = np.zeros(256, np.int64)
        self.classes[bytes_used] = np.arange(1, len(bytes_used) + 1)
        states, table, out = {closed({(0, 0)}): 0, frozenset(): 1}, [], []
        queue = list(states)
        for s in queue:
            row = []
            for b in [-1, *bytes_used]:
                nxt: set[tuple[int, int]] = set()
                for node, e in s:
                    if b in child[node]:
                        nxt.add((child[node][b], e))
                    if node or root:
                        nxt.add((node, e + 1))
                        nxt.update((c, e + 1) for c in child[node].values())
                t = closed(nxt)
                if t not in states:
                    states[t] = len(states)
                    queue.append(t)
                row.append(states[t])
            table.append(row)
            found = [end[n][1] + (2 if e else 0) for n, e in s if n in end and e <= end[n][0]]
            out.append(min(found, default=0))
        self.table = np.array(table, np.int32)
        self.out = np.array(out, np.int8)

    def walk(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The result for each word, all words a byte at a time."""
        state = np.zeros(len(start), np.int32)
        left = np.arange(len(start))
        at = 0
        while len(left):
            left = left[start[left] + at < end[left]]
            state[left] = self.table[state[left], self.classes[raw[start[left] + at]]]
            left = left[state[left] != 1]  # no term can be reached any more
            at += 1
        return self.out[state]


class Lexicon:
    """Automata of bounded size over all terms."""

    def __init__(self, terms: list[str], words: list[str], root: bool = False):
        both = sorted([(t, TERM) for t in terms] + [(t, WORD) for t in words])  # neighbours share beginnings
        parts = [both[a : a + TRIE_TERMS] for a in range(0, len(both), TRIE_TERMS)]
        self.parts = [Automaton([t for t, k in p if k == TERM], [t for t, k in p if k == WORD], root) for p in parts]

    def walk(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The best result for each word."""
        best = np.full(len(start), 99, np.int8)
        for p in self.parts:
            got = p.walk(raw, start, end)
            best = np.where(got > 0, np.minimum(best, got), best)
        return np.where(best == 99, 0, best).astype(np.int8)


#: Columns of the features: terms, misspelled terms, words of families, quoted hits, words, and hits of the second walk.
COLUMN = np.array([0, 0, 2, 1, 2, 5])
NAMES = ("terms", "misspelled", "families", "quoted", "words", "loose")


@dataclass
class Model:
    """Lexicon, hashes of known clean words that look like a misspelling, words of report, regression weights (bias
    first), and the labelled documents with each kind of hit (not toxic, toxic)."""

    terms: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    clean: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    reports: tuple[str, ...] = REPORTS
    weights: np.ndarray | None = None
    support: dict[str, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self):
        self.lexicon = Lexicon(self.terms, self.words)
        self.loose = Lexicon(self.terms, [], root=True)
        raw = "\n".join(self.reports).encode()
        a = np.frombuffer(raw, np.uint8)
        self.report_keys = np.unique(Words(a, np.array([0, len(a)]), _BREAKS, lower=False).hash)

    def kinds(self, w: Words, first: np.ndarray) -> np.ndarray:
        """The hit, if any, that each of the words ``first`` is by its spelling alone."""
        kind = self.lexicon.walk(w.raw, w.start[first], w.end[first])
        rest = np.flatnonzero(kind == 0)
        kind[rest[self.loose.walk(w.raw, w.start[first[rest]], w.end[first[rest]]) > 0]] = LOOSE
        return kind

    def features(self, column: pa.Array) -> np.ndarray:
        """Of each text: terms, misspelled terms and words of families outside quotation, all hits inside it, its words,
        and terms outside quotation whose first letter is wrong or that are disguised by digits or symbols."""
        raw, offsets = _lowered(column)
        w = Words(raw, offsets, _BREAKS, lower=False)
        out = np.zeros((w.texts, len(NAMES)))
        out[:, 4] = np.diff(w.offsets)
        if not len(w.hash):
            return out
        key, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        kind = self.kinds(w, first)
        kind[(kind > WORD) & np.isin(key, self.clean)] = 0
        kind = kind[which]
        start, end = disguised(raw, offsets)
        before = np.concatenate([[0], np.cumsum(kind > 0)])
        lo, hi = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
        new = (before[hi] == before[lo]) & (lo < hi)  # no part is a hit by itself
        start, end, lo = start[new], end[new], lo[new]
        kind[lo[self.loose.walk(w.raw, start, end) > 0]] = LOOSE  # stands at the first part
        hits = np.flatnonzero(kind)
        text = np.searchsorted(w.offsets, hits, "right") - 1
        if len(hits):
            mark = np.concatenate([[0], np.cumsum(w.raw == 34)])
            report = np.concatenate([[0], np.cumsum(np.isin(w.hash, self.report_keys))])
            lo, hi = np.maximum(hits - WINDOW, w.offsets[text]), np.minimum(hits + WINDOW, w.offsets[text + 1] - 1)
            before = mark[w.start[hits]] - mark[w.start[lo]]
            after = mark[w.end[hi]] - mark[w.end[hits]]
            edge = mark[np.minimum(w.end[hits] + 1, len(w.raw))] > mark[w.end[hits]]
            quoted = ((before % 2 == 1) & ((after > 0) | edge)) | (report[hi + 1] > report[lo])
            np.add.at(out, (text, np.where(quoted, 3, COLUMN[kind[hits]])), 1)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(column))
        return 1 / (1 + np.exp(-(_design(self.features(column)) @ self.weights)))


def _design(x: np.ndarray) -> np.ndarray:
    hits, family, words, loose = x[:, :4], x[:, 2:3], x[:, 4:5], x[:, 5:]
    return np.hstack([np.ones((len(x), 1)), np.log1p(hits), np.minimum(hits, 1), np.minimum(np.maximum(family - 1, 0), 2), np.log1p(1000 * family / np.maximum(words, 50)), np.log1p(loose), np.minimum(loose, 1)])


#: Weights before any row is seen, by column of the design: a term counts, a misspelled or disguised one or a word of a
#: family half as much, a quoted hit a quarter.
PRIOR = np.array([0, 1, 0.5, 0.5, 0.25, 2, 1, 0.5, 0.25, 0.5, 0.1, 0.5, 1])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression towards ``PRIOR``, by Newton's method."""
    d, prior = _design(x), PRIOR
    ridge = np.array([1e-3] + [1.0] * 12)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-(d @ w)))
        step = np.linalg.solve((d * (p * (1 - p) + 1e-9)[:, None]).T @ d + np.diag(ridge), d.T @ (y - p) - ridge * (w - prior))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _entries(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, entry) pairs: key, text, start, end, and whether the entry is a whole word."""
    of = w.text_of()
    key = w.hash ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    of, start, end = of[first], w.start[first], w.end[first]
    heads = np.append(np.flatnonzero((w.raw & 0xC0) != 0x80), len(w.raw))
    at, length = np.searchsorted(heads, start), np.searchsorted(heads, end) - np.searchsorted(heads, start)
    keys, texts, starts, ends, whole = [w.hash[first]], [of], [start], [end], [np.ones(len(of), bool)]
    for n in STEMS:
        long = length > n
        stop = heads[at[long] + n]
        h = span_hash(w.prefix, start[long], stop) ^ np.uint64(n)
        _, one = np.unique(h ^ (of[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        keys.append(h[one])
        texts.append(of[long][one])
        starts.append(start[long][one])
        ends.append(stop[one])
        whole.append(np.zeros(len(one), bool))
    return tuple(np.concatenate(x) for x in (keys, texts, starts, ends, whole))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, reports: tuple[str, ...] = REPORTS) -> Model:
    """Learn lexicon and weights from ``labels`` (doc_id, toxic) and the texts of their documents; a hit near one of
    ``reports``, the words by which other people's words are told, counts as quoted."""
    with scratch():
        return _train(docs, labels, max_docs, reports)


def _train(docs: DataFrame, labels: DataFrame, max_docs: int, reports: tuple[str, ...]) -> Model:
    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, max_docs / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    sample = written(sample.select("text", "toxic"), "labelled")  # max_docs rows at most, or about as many

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words_of(part.column("text"))
                if not len(w.hash):
                    continue
                toxic = part.column("toxic").to_numpy() > 0
                key, of, start, end, whole = _entries(w)
                uniq, first, which = np.unique(key, return_index=True, return_inverse=True)
                bad = np.bincount(which, weights=toxic[of], minlength=len(uniq)).astype(np.int64)
                raw = w.raw.tobytes()
                text = [None] * len(uniq)
                for k in np.flatnonzero(whole[first] | (bad > 0)).tolist():  # other beginnings are only counted
                    text[k] = raw[start[first[k]] : end[first[k]]].decode(errors="replace")
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(np.bincount(which, minlength=len(uniq))), pa.array(bad), pa.array(whole[first]), pa.array(text, pa.string())], names=["key", "n", "bad", "whole", "entry"])

    tally = sample.mapInArrow(count, "key long, n long, bad long, whole boolean, entry string")
    tally = tally.groupBy("key", "whole").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("entry").alias("entry"))
    tally = written(tally, "tally")
    mostly = F.col("bad") >= PURE_STEM * F.col("n")
    got = tally.filter((F.col("bad") >= LEAST_GAIN) & (F.col("bad") >= F.when(F.col("whole"), PURE).otherwise(PURE_STEM) * F.col("n"))).toArrow()
    candidates = sorted(zip(*(got.column(c).to_pylist() for c in ("entry", "whole", "key", "bad", "n")), strict=True))
    order = np.argsort(np.array([c[2] for c in candidates], np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast((np.array([c[2] for c in candidates], np.int64).view(np.uint64)[order], order))

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, order = sent.value
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words_of(part.column("text"))
                found: list[list[int]] = [[] for _ in range(part.num_rows)]
                if len(keys) and len(w.hash):
                    key, of, *_ = _entries(w)
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    good = keys[at] == key
                    for k, c in zip(of[good].tolist(), order[at[good]].tolist(), strict=True):
                        found[k].append(c)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["entries"])

    rows = sample.filter("toxic > 0").select("text").mapInArrow(incidence, "entries array<int>").toArrow().column("entries").to_pylist()
    terms, stems = _cover(candidates, rows)
    begins = F.lit(False)
    for stem in stems:
        begins |= F.col("entry").startswith(stem)
    family = sorted({r["entry"] for r in tally.filter(F.col("whole") & mostly & begins).select("entry").collect()} - {*terms, *stems})
    draft = spark.sparkContext.broadcast(Model(terms, family, reports=reports))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words_of(batch.column("entry"))
            one = np.flatnonzero(np.diff(w.offsets) == 1)
            first = w.offsets[one]
            hit = draft.value.kinds(w, first) > WORD if len(first) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(w.hash[first[hit]].view(np.int64))], names=["key"])

    clean = tally.filter(F.col("whole") & ~mostly).select("entry").mapInArrow(near, "key long").toArrow().column("key").to_numpy().view(np.uint64)
    model = Model(terms, family, np.unique(clean), reports)
    shared = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                x = shared.value.features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), *[pa.array(x[:, j]) for j in range(len(NAMES))]], names=["toxic", *NAMES])

    t = sample.mapInArrow(features, "toxic int, " + ", ".join(f"{c} double" for c in NAMES)).toArrow()
    y, x = t.column("toxic").to_numpy() > 0, np.stack([t.column(c).to_numpy() for c in NAMES], axis=1)
    model.support = {c: (int((x[~y, j] > 0).sum()), int((x[y, j] > 0).sum())) for j, c in enumerate(NAMES)}
    if y.any() and not y.all():
        model.weights = _fit(x, y.astype(float))
    return model


def _cover(candidates: list[tuple[str, bool, int, int, int]], rows: list[list[int]]) -> tuple[list[str], list[str]]:
    """Greedy cover of toxic documents by candidates, weighed by how pure they are; of equal ones whole words come
    first, then longer ones."""
    docs: list[list[int]] = [[] for _ in candidates]
    for d, entries in enumerate(rows):
        for c in entries:
            docs[c].append(d)
    gain = np.array([len(d) for d in docs])
    rank = np.array([(1000 if whole else 0) + len(text) for text, whole, *_ in candidates])
    pure = np.array([bad / n for *_, bad, n in candidates])
    least = max(LEAST_GAIN, LEAST_SHARE * len(rows))
    covered = np.zeros(len(rows), bool)
    terms, stems = [], []
    while len(gain):
        best = int(np.lexsort((-rank, -gain * pure))[0])
        if gain[best] < least:
            break
        (terms if candidates[best][1] else stems).append(candidates[best][0])
        for d in docs[best]:
            if not covered[d]:
                covered[d] = True
                gain[rows[d]] -= 1
    return terms, stems


def score(df: DataFrame, model: Model) -> DataFrame:
    """The columns of ``df`` but ``text``, with ``score`` of each whole text."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*[f for f in df.schema.fields if f.name not in ("text", "score")], StructField("score", DoubleType())])
    names = [f.name for f in schema.fields[:-1]]
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(sent.value.scores(part.column("text")))], names=[*names, "score"])

    return df.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """``op9_toxicity``: held out are the rows whose crc32 modulo 5 is 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(remainder("doc_id", 5) != 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(rows, model).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
