import random

import pyarrow as pa
import pytest

from hexloom.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(item, doc, least):
    """Greedy string tiling as published: the longest unmarked matches first, quadratic scans."""
    used_i, used_j, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_j:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        used_i.update(range(i, i + n))
        used_j.update(range(j, j + n))
        out.append((i, j, n))


@pytest.mark.parametrize("seed", range(25))
def test_tiles_against_brute_force(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(rng.choice([3, 6, 30]))]
    item = [rng.choice(vocab) for _ in range(rng.randrange(5, 30))]
    doc = []
    for _ in range(rng.randrange(1, 5)):
        a = rng.randrange(len(item))
        doc += item[a : a + rng.randrange(1, 20)] + [rng.choice(vocab) for _ in range(rng.randrange(4))]
    w = D.words_of(pa.array([" ".join(item), " ".join(doc)]))
    x, y = w.hash[: w.offsets[1]], w.hash[w.offsets[1] :]
    sx, sy = D.windows(x, 5).tolist(), D.windows(y, 5).tolist()
    seeds = [(i, j) for i, p in enumerate(sx) for j, q in enumerate(sy) if p == q]
    import numpy as np

    got = D.tiles(x, y, np.array([s[0] for s in seeds], int), np.array([s[1] for s in seeds], int)) if seeds else []
    want = brute(item, doc, 5)
    assert got == want  # ties, too: first in the item, then in the document
    assert D.tiles_by_length(x, y) == want
    for i, j, n in got:
        assert item[i : i + n] == doc[j : j + n]


def test_leaks_reordered_and_clean(spark):
    words = [f"word{k}" for k in range(40)]
    text = " ".join(words)
    reordered = " ".join(words[20:] + ["between", "them"] + words[:20]).upper() + "!"
    docs = spark.createDataFrame([(1, f"some lead {text} and more"), (2, reordered), (3, " ".join(words[:15])), (4, "clean text"), (5, None), (6, ""), (2, reordered)], DOCS)
    items = spark.createDataFrame([(7, text), (8, None), (9, "too short here"), (10, "")], ITEMS)
    got = sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in D.leaks(docs, items).collect())
    assert got == [(1, 7, 1.0, 1), (2, 7, 1.0, 2), (2, 7, 1.0, 2)]
    assert sorted(r.doc_id for r in D.clean(docs, items).collect()) == [3, 4, 5, 6]
    many = sorted((r.doc_id, r.item_id) for r in D.leaks(docs, items, block_bytes=64).collect())
    assert many == [(1, 7), (2, 7), (2, 7)]
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0


def test_query_on_the_tables(spark):
    rows = D.query(spark, "/root/testdata/sf0.001").collect()
    assert all(D.COVERAGE <= r.coverage <= 1 and r.matched_words == round(r.coverage * r.item_words) for r in rows)


def test_repetitive_texts_stay_small():
    import tracemalloc

    item, doc = " ".join(["again"] * 20_000), " ".join(["again"] * 20_000)
    block = D.Block([1], pa.array([item]), 5)
    w = D.words_of(pa.array([doc, " ".join(["a", "b"] * 9_000)]))
    tracemalloc.start()
    (found,) = block.leaks(w, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == (0, 0, 1.0, 1, 20_000) and peak < 500 << 20


def test_both_ways_give_the_same(monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(30)]
    block, w = D.Block(list(range(10)), pa.array(texts[:10]), 5), D.words_of(pa.array(texts[10:]))
    want = list(block.leaks(w, 0.1))
    monkeypatch.setattr(D, "MOST_PAIRS", 0)
    assert list(block.leaks(w, 0.1)) == want and want


def test_long_text_and_columns_beside(spark):
    passage = " ".join(f"p{k}" for k in range(50))
    text = " ".join(f"x{k}" for k in range(30_000)) + " " + passage + " " + " ".join(f"y{k}" for k in range(30_000))
    docs = spark.createDataFrame([(1, text, 3, "a"), (2, "other", 4, None)], "doc_id long, text string, item_id int, coverage string")
    items = spark.createDataFrame([(None, passage)], ITEMS)
    assert [(r.doc_id, r.item_id, r.matched_words) for r in D.leaks(docs, items).collect()] == [(1, None, 50)]
    assert [tuple(r) for r in D.clean(docs, items).collect()] == [(2, "other", 4, None)]
