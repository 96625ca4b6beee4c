import random
import re

import numpy as np
import pytest

from hexloom.llm import jaccard_join as J

SCHEMA = "doc_id long, text string"


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (x := len(sets[a] & sets[b])) and 100 * x >= 80 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(comp[a], comp[b])
            moved |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return {(d, len(sets[d]), comp[d]) for d in ids}


def result(spark, rows):
    return {tuple(r) for r in J.join(spark.createDataFrame(rows, SCHEMA)).collect()}


def near_copies(seed, groups, copies, words):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice(words))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 25)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(t).upper() if rng.random() < 0.2 else "\n".join(t)))
    return rows


def test_against_brute_force(spark):
    rows = near_copies(1, 25, 6, [4, 5, 6, 8, 9, 12, 20, 40, 90, 200])
    assert result(spark, rows) == brute(rows)


def test_long_runs_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "NEAREST", 1)
    monkeypatch.setattr(J, "BLOCK", 7)
    rows = near_copies(2, 2, 60, [60, 70])
    assert result(spark, rows) == brute(rows)


def test_overlapping_runs_of_unlinked_documents(spark, monkeypatch):
    """Chains of documents that drift apart, with many common passages: long runs of many components."""
    monkeypatch.setattr(J, "NEAREST", 2)
    monkeypatch.setattr(J, "BLOCK", 16)
    rng = random.Random(5)
    rows = []
    for _ in range(4):
        t = [f"w{rng.randrange(300)}" for _ in range(120)]
        for k in range(80):
            t = list(t)
            for _ in range(1 + k % 4):
                t[rng.randrange(len(t))] = f"w{rng.randrange(300)}"
            rows.append((len(rows), " ".join(t)))
    rng.shuffle(rows)
    got, want = result(spark, rows), brute(rows)
    assert got == want
    assert len({c for _, _, c in want}) > 8


def test_partners_share_as_many_keys_as_needed():
    rng = np.random.default_rng(8)
    seen = 0
    for size in (9, 33, 60, 120, 300, 700):
        for _ in range(10):
            a = np.unique(rng.integers(0, 1 << 60, size).astype(np.uint64))
            b = np.unique(np.concatenate([a[size // 10 :], rng.integers(0, 1 << 60, size // 10).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared < 80 * (len(a) + len(b) - shared):
                continue
            keys = [J.keys_of(x, np.array([0, len(x)]), 80) for x in (a, b)]
            for k, _, mark in keys:
                both = np.isin(k, keys[1][0] if k is keys[0][0] else keys[0][0])
                # of the entries in which the two meet, one keeps to the bound
                least = [(both & (mark == m)).sum() >= (m & 127) for m in np.unique(mark)]
                assert any(least)
                seen += any(int(m & 127) > 3 for m in mark)
    assert seen > 20


def test_null_ids_join_what_they_link(spark):
    words = [f"w{k}" for k in range(60)]
    far, mid = list(words), list(words)
    mid[10] = "x"
    far[10] = "x"
    far[40] = "y"
    got = J.join(spark.createDataFrame([(5, " ".join(words)), (None, " ".join(mid)), (7, " ".join(far))], SCHEMA))
    assert {r.component_id for r in got.collect()} == {5}


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (7, "a b c d e"), (8, "a b c d e f g h i"), (9, "x b c d e f g h i")]
    want = {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 5, 8), (9, 5, 9)}
    assert result(spark, rows) == want
    got = J.join(spark.createDataFrame([(None, "a b c"), (3, "a b c"), (2, "a b c"), (2, "a b c")], SCHEMA)).collect()
    assert sorted(((r.doc_id or 0), r.component_id) for r in got) == [(0, 2), (2, 2), (2, 2), (3, 2)]
    assert J.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hamming_distance_bounds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = rng.integers(0, 1 << 60, 80).astype(np.uint64)
        b = np.concatenate([a[: rng.integers(1, 80)], rng.integers(0, 1 << 60, 20).astype(np.uint64)])
        x, y = (int.from_bytes(J.sketch(s, 6)) for s in (a, b))
        assert (x ^ y).bit_count() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("size", [4, 5, 9, 33, 120, 700])
def test_pigeonhole_keys_meet(size):
    rng = np.random.default_rng(size)
    for _ in range(20):
        a = np.unique(rng.integers(0, 1 << 60, size).astype(np.uint64))
        more = int(rng.integers(0, size // 4 + 1))
        less = max(0, (size + more) // 9 - more)
        b = np.unique(np.concatenate([a[less:], rng.integers(0, 1 << 60, min(more, (2 * size + more) // 9)).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 80 * (len(a) + len(b) - shared) or len(a) == len(b) == shared:
            continue
        keys = [set(J.keys_of(x, np.array([0, len(x)]), 80)[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_stage_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (1, "a b c d e f", "x"), (3, "other text here", None), (None, "a b c d e f", "z"), (4, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    got = sorted((r.doc_id or 0, r.gone or "") for r in J.stage(spark, docs, "").collect())
    assert got == [(0, "z"), (1, "x"), (3, ""), (4, "w")]


def test_a_run_of_many_components(spark, monkeypatch):
    """Documents that share a passage and do not link: runs of more nodes than a cell holds, nearly all of them alone."""
    common = " ".join(f"common{k}" for k in range(24))
    rows = []
    for d in range(27_000):
        tail = [f"own{d - d % 2}x{k}" if d % 500 < 2 and k < 9 else f"own{d}x{k}" for k in range(10)]
        rows.append((d, f"{common} {' '.join(tail)}"))
    sizes = []
    real = J._across

    def across(members, *rest):
        sizes.append(members.groupBy("run").count().agg({"count": "max"}).first()[0])
        return real(members, *rest)

    monkeypatch.setattr(J, "_across", across)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs).collect()}
    assert got == {d: (30, d - 1 if d % 500 == 1 else d) for d, _ in rows}
    assert sizes[0] > J.BLOCK
