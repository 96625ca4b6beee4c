import collections
import math
import random

import pytest

from hexloom.llm import quality as Q


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney trigrams, written with dictionaries; gives a text's log probability."""
    counts = [collections.Counter() for _ in range(4)]
    for t in texts:
        w = t.split()
        if w:
            s = ["<", "<", *w, ">"]
            counts[3].update(zip(s, s[1:], s[2:], strict=False))
    counts[2] = collections.Counter((y, z) for _, y, z in counts[3])
    counts[1] = collections.Counter((z,) for _, z in counts[2])

    def discounts(c):
        n = [max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [(1 - 2 * y * n[1] / n[0], 0.95), (2 - 3 * y * n[2] / n[1], 1.9), (3 - 4 * y * n[3] / n[2], 2.85)]
        return [min(max(d, 0.05), cap) for d, cap in raw]

    cut = {k: discounts(counts[k]) for k in (1, 2, 3)}
    words = len(counts[1])

    def p(k, gram):
        if k == 0:
            return 1 / (words + 1)
        own = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        low = p(k - 1, gram[1:])
        if not own:
            return low
        total = sum(own.values())
        mass = sum(cut[k][min(n, 3) - 1] for n in own.values()) / total
        n = counts[k].get(gram, 0)
        return (n - cut[k][min(n, 3) - 1] if n else 0) / total + mass * low

    def log(text):
        w = text.split()
        s = ["<", "<", *w, ">"]
        return sum(math.log(p(3, g)) for g in zip(s, s[1:], s[2:], strict=False)) if w else 0.0

    return log, p, words


TEXTS = ["a b c a b", "a b d", "b c a", "c a b c d", "a a b b c", "a b c a b", "d d d a", "e f a b", "", "b"]


@pytest.mark.parametrize("hot", [0, 4, 1 << 18])
def test_against_brute_force(spark, monkeypatch, hot):
    """With all n-grams joined by cell, some, and none."""
    monkeypatch.setattr(Q, "HOT", hot)
    monkeypatch.setattr(Q, "COPY_BYTES", 400)
    monkeypatch.setattr(Q, "FLUSH_HITS", 20)
    monkeypatch.setattr(Q, "FLUSH_ROWS", 7)
    m = Q.train(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    log, _, _ = kneser_ney(TEXTS)
    rng = random.Random(3)
    asked = [*TEXTS, "x", "a x b", "b c x d a", None] + [" ".join(rng.choice("abcdefx") for _ in range(rng.randrange(12))) for _ in range(40)]
    rows = [(k, t, "own", 1.5) for k, t in enumerate(asked)]
    got = Q.perplexities(spark.createDataFrame(rows, "row long, text string, part string, sum double").repartition(3), m)
    assert got.columns == ["row", "part", "sum", "log_sum", "n_tokens"]
    for r in got.collect():
        t = asked[r.row] or ""
        assert r.part == "own" and r.n_tokens == (len(t.split()) + 1 if t.split() else 0)
        assert r.log_sum == pytest.approx(log(t), abs=1e-5), t


def test_blobs_that_only_passed_by_chance(spark, monkeypatch):
    """Every n-gram passes the filter, and most blobs hold none of the model."""
    import numpy as np

    monkeypatch.setattr(Q, "HOT", 0)
    m = Q.train(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    m.seen = np.full_like(m.seen, 255)
    log, _, _ = kneser_ney(TEXTS)
    asked = ["p q r s t u v w", "x y", "a b"]
    got = Q.perplexities(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), m).collect()
    assert {r.doc_id: r.log_sum for r in got} == pytest.approx({k: log(t) for k, t in enumerate(asked)}, abs=1e-5)


def test_probabilities_add_up():
    _, p, _ = kneser_ney(TEXTS)
    for x in "<abcde":
        for y in "abcde":
            assert sum(p(3, (x, y, z)) for z in [*"abcdef", ">", "unknown"]) == pytest.approx(1, abs=1e-9)


def test_a_filter_and_slots_hold_what_they_were_given():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 63, 400_000).astype(np.uint64)
    m = Q.Model.of(keys, np.arange(400_000.0), rng.integers(1, 50, 400_000), -9.0, 0.0)
    value, maybe = m.hot(keys)
    held = np.isin(keys, m.keys)
    assert 400_000 - Q.HOT <= len(m.keys) < 400_000 and (maybe == held).all() and (value[~held] == np.arange(400_000.0)[~held]).all()
    assert m.hot(rng.integers(1, 1 << 63, 100_000).astype(np.uint64))[1].mean() < 0.05


def test_trusted_text_is_kept_and_junk_goes(spark):
    sf = "/root/testdata/sf0.1"
    rows = Q.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, junk = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in good) >= 0.985 * len(good)
    assert sum(not r.keep for r in junk) >= 0.6 * len(junk)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "en", None), (2, None, ""), (3, "en", "some words"), (3, "en", "some words")], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = Q.classify(docs, labels.limit(0)).collect()
    assert sorted((r.doc_id, r.keep) for r in got) == [(1, False), (2, False), (3, True), (3, True)]
    assert len(Q.classify(docs, labels).collect()) == 4
    assert Q.classify(docs.limit(0), labels).count() == 0


def test_rare_language_is_learned_whole(spark):
    rows = [(i, "en", f"the common word{i % 7} of many rows") for i in range(600)] + [(1000 + i, None if i % 2 else "qq", f"own{i} text") for i in range(12)]
    m = Q.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), max_docs=60)
    asked = spark.createDataFrame([(i, f"own{i}") for i in range(12)] + [(99, "never")], "doc_id long, text string")
    logs = {r.doc_id: r.log_sum for r in Q.perplexities(asked, m).collect()}
    assert min(v for k, v in logs.items() if k != 99) > logs[99] + 0.1


def test_all_trusted_rows_teach(spark):
    """More rows than the 3,000 that a fit once read: every row's own words are known."""
    rows = [(i, "en", f"own{i} the common words") for i in range(4_000)]
    m = Q.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    asked = spark.createDataFrame([(i, f"own{i}") for i in range(4_001)], "doc_id long, text string")
    logs = {r.doc_id: r.log_sum for r in Q.perplexities(asked, m).collect()}
    assert min(v for k, v in logs.items() if k < 4_000) > logs[4_000] + 0.1


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_a_model_of_many_cells_and_a_full_filter(spark, monkeypatch, sent):
    monkeypatch.setattr(Q, "HOT", 4)
    monkeypatch.setattr(Q, "CELL_GRAMS", 1)
    monkeypatch.setattr(Q, "SEEN_BITS", 10)
    monkeypatch.setattr(Q, "FLUSH_GRAMS", 20)
    monkeypatch.setattr(Q, "SENT_WORDS", sent)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(15))) for _ in range(60)]
    m = Q.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert m.cell_bits > Q.CELL_BITS
    log, _, _ = kneser_ney(texts)
    asked = [*texts, "x", "a x b"]
    got = Q.perplexities(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), m).collect()
    assert {r.doc_id: r.log_sum for r in got} == pytest.approx({k: log(t) for k, t in enumerate(asked)}, abs=1e-4)


def test_what_was_used_leaves_the_disk(spark, monkeypatch):
    """Trigrams are counted share by share; while cells are made no trigrams are left, nor blobs of the rounds before."""
    from pathlib import Path

    from hexloom.sources.shared import shared_dir, written

    top = Path(shared_dir(spark).removeprefix("file://"))
    before, left, rows = set(top.iterdir()), [], []

    def spy(df, name, **how):
        out = written(df, name, **how)
        if name == "trigrams":
            rows.append(out.count())
        if name == "cells":
            now = [d for d in top.iterdir() if d not in before]
            left.append(({d.name.split("-")[0] for d in now}, {int(t.name.split("=")[1]) for d in now for t in d.glob("turn=*")}))
        return out

    monkeypatch.setattr(Q, "written", spy)
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(30)) for _ in range(100)]
    Q.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    s = [["<", "<", *t.split(), ">"] for t in texts]
    assert sum(rows) == len({g for w in s for g in zip(w, w[1:], w[2:], strict=False)}) and max(rows) < 0.6 * sum(rows)
    assert [names for names, _ in left] == [{"words", "told", "cells"}] * Q.ROUNDS
    assert [turns for _, turns in left] == [set(range(k, Q.ROUNDS)) for k in range(Q.ROUNDS)]


def test_thresholds_are_exact(spark):
    """An odd number of values, of which a sketch of 10,000 can only come near the quantile."""
    rng = random.Random(6)
    values = [(rng.choice(["a", "b", None]), rng.random()) for _ in range(60_001)]
    df = spark.createDataFrame(values, "lang string, s double")
    for q in (0.0, 0.5, 0.995, 1.0):
        for got in [*Q._ranked(df, q, "lang").collect(), Q._ranked(df, q).first()]:
            own = sorted(s for lang, s in values if "lang" not in got or lang == got["lang"])
            assert got["n"] == len(own) and got["q"] == own[max(1, math.ceil(q * len(own))) - 1]
    assert Q._ranked(df.limit(0), 0.5).first() is None


def test_long_text_and_ties(spark):
    text = "a b c d " * 15_000
    docs = [(1, "en", text), (2, "en", "a b c d"), (2, "en", "a b c d"), (None, "en", "a b")]
    got = Q.classify(spark.createDataFrame(docs, "doc_id long, lang string, text string"), spark.createDataFrame([(1, 1), (2, 1), (None, 1), (7, None)], "doc_id long, quality int")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 60_001), (2, 5), (2, 5)]
