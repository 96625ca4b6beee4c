import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from hexloom.llm import lm_scoring as S
from hexloom.llm.elias_fano import EliasFano, Trie


@pytest.mark.parametrize(("n", "top"), [(0, 5), (1, 1), (1, 2**62), (1000, 1200), (5000, 2**40), (3000, 2**61), (300, 3)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n + top % 97)
    v = np.sort(rng.integers(0, top, n).astype(np.uint64))
    e = EliasFano.build(v)
    assert (e.select(np.arange(n)) == v).all()
    asked = np.concatenate([v, rng.integers(0, top, 400).astype(np.uint64), v + np.uint64(1)])
    if n:
        assert (e.successor(asked) == np.searchsorted(v, asked)).all()
    assert ((e.find(asked) >= 0) == np.isin(asked, v)).all()


def test_trie_file(tmp_path):
    rng = np.random.default_rng(5)
    y, z = rng.integers(0, 2**62, 60).astype(np.uint64)[rng.integers(0, 60, 2000)], rng.integers(0, 2**40, 2000).astype(np.uint64)
    order = np.lexsort((z, y))
    y, z = y[order], z[order]
    Trie.build(y, z, np.arange(1, 2001, dtype=np.uint16)).save(str(tmp_path / "t"))
    t = Trie.load(str(tmp_path / "t"))
    assert (t.find(y, z) == np.arange(1, 2001)).all() and (t.find(y, z ^ np.uint64(1 << 39)) == 0).all()
    assert (t.fan_out(y) == np.bincount(np.unique(y, return_inverse=True)[1])[np.unique(y, return_inverse=True)[1]]).all()
    t.pointers = EliasFano.build(np.array([0, 2000], np.uint64))
    with pytest.raises(IndexError):  # nothing is found without the ranges
        t.find(y, z)
    Trie.build(y[:0], z[:0], np.zeros(0, np.uint16)).save(str(tmp_path / "e"))
    assert (Trie.load(str(tmp_path / "e")).find(y, z) == 0).all()


def expected(rows):
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), 1]
    c, pairs, docs = collections.Counter(), collections.Counter(), 0
    for _, t, held in rows:
        if not held:
            w = tok(t)
            c.update(w)
            pairs.update(zip([0, *w], w, strict=False))
            docs += 1
    n, v = sum(c.values()), len(c)
    c[0] = docs
    base = lambda z: (c[z] + 1) / (n + v + 1)
    for d, t, held in rows:
        w = tok(t)
        score = sum(math.log10((pairs[y, z] + S.PRIOR * base(z)) / (c[y] + S.PRIOR)) for y, z in zip([0, *w], w, strict=False))
        yield d, held, len(w), sum(c[z] > 0 for z in w), n, sum(math.log10(base(z)) for z in w), score


@pytest.mark.parametrize("split", [500_000, 3])
def test_against_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(S, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(S, "SPLIT", split)
    rng = random.Random(7)
    vocab = [f"W{k}" for k in range(40)]
    rows = [(d, " ".join(rng.choice(vocab) for _ in range(rng.randrange(40))), zlib.crc32(str(d).encode()) % 7 == 2) for d in range(90)]
    rows += [(100, None, False), (101, "", True), (101, "", True), (102, "unseen words", True)]
    got = sorted(tuple(r) for r in S.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect())
    want = sorted(expected(rows))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-9) and g[6] == pytest.approx(w[6], abs=2e-4 * w[2])


def test_no_training_rows_and_empty(spark):
    schema = "doc_id long, text string, held_out boolean"
    got = S.score(spark.createDataFrame([(1, "a b", True)], schema)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)]
    assert S.score(spark.createDataFrame([], schema)).count() == 0


def _left(spark):
    import os

    folder = S.shared_dir(spark).removeprefix("file://")
    return {f for f in os.listdir(folder) if not f.startswith("scores-")}


def test_nothing_is_left_behind(spark, monkeypatch):
    schema = "doc_id long, text string, held_out boolean"
    before, tables = _left(spark), [t.name for t in spark.catalog.listTables()]
    S.score(spark.createDataFrame([(1, "a b", True), (2, "a b c", False)], schema)).collect()
    S.score(spark.createDataFrame([], schema)).collect()
    monkeypatch.setattr(S, "_answer_pairs", None)
    with pytest.raises(Exception, match="."):
        S.score(spark.createDataFrame([(2, "a b c", False)], schema)).collect()
    assert _left(spark) == before and [t.name for t in spark.catalog.listTables()] == tables


def test_long_text_ties_and_columns_beside(spark):
    text = " ".join(f"w{k % 5000}" for k in range(60_000))
    rows = [(1, text, False, 3, "x"), (1, text, False, 3, "x"), (2, "w1 w2", True, None, None)]
    got = sorted(tuple(r) for r in S.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, n_tokens int, score string")).collect())
    want = sorted(expected([r[:3] for r in rows]))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], abs=2e-4 * w[2])


def test_beats_the_base_on_held_out_text(spark):
    r = S.query(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r.s > r.b
