import random
import re

from hexloom.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n_chars long"


def brute(rows):
    words = lambda s: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), s))
    lines = [(d, k, words(s), s) for d, t, _ in rows if t is not None for k, s in enumerate(t.split("\n"))]

    def alike(a, b):
        if a == b:
            return True
        if max(len(a), len(b)) < L.NEAR_WORDS or abs(len(a) - len(b)) > 1:
            return False
        table = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, table[0] = table[0], i
            for j, y in enumerate(b, 1):
                last, table[j] = table[j], min(table[j] + 1, table[j - 1] + 1, last + (x != y))
        return table[-1] <= 1

    firsts = {}
    for d, k, w, _ in sorted(lines, key=lambda x: (x[0], x[1])):
        if w and tuple(w) not in firsts:
            firsts[tuple(w)] = (d, k)
    keep = {p for w, p in firsts.items() if not any(q < p and alike(list(w), list(v)) for v, q in firsts.items())}
    out = {}
    for d, k, w, s in lines:
        if not w or (d, k) in keep:
            out.setdefault(d, []).append(s)
    had = {d for d, _, w, _ in lines if w}
    left = {d for d, k in keep}
    return {d: "\n".join(out.get(d, [])) if t is not None else None for d, t, _ in rows if d not in had or d in left}


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(60)]
    pool = [[rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 6, 7, 8, 9, 10, 15, 16, 17, 24, 31]))] for _ in range(60)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(w))
                w[p : p + rng.choice([0, 1])] = rng.choice([[], [rng.choice(vocab)]]) or w[p : p + 1]
            if rng.random() < 0.3 and len(w) > 1:
                del w[rng.randrange(len(w))]
            lines.append(rng.choice([" ", "\t", "  "]).join(w) if rng.random() < 0.9 else "")
        text = "\n".join(lines)
        rows.append((d, text, len(text)))
    got = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_defined_cases(spark):
    rows = [(1, None, None), (2, "", 0), (3, "a\na\n\nb", 6), (4, "A ", 2), (5, "\n\n", 2), (None, "b\nc", 3), (6, "c", 1)]
    got = {r.doc_id: (r.text, r.n_chars) for r in L.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (None, None), 2: ("", 0), 3: ("a\n\nb", 4), 5: ("\n\n", 2), 6: ("c", 1)}
    df = spark.createDataFrame([(1, "x", 1, "k", 2)], SCHEMA + ", lines string, _own int")
    assert [tuple(r) for r in L.dedup(df).select("doc_id", "text").collect()] == [(1, "x")]
    assert L.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shuffled_instead_of_sent(spark, monkeypatch):
    monkeypatch.setattr(L, "SENT_ROWS", 0)
    line = " ".join(f"w{k}" for k in range(12))
    rows = [(1, line, 0), (2, line.replace("w5", "other"), 0), (3, line.replace("w5 ", ""), 0), (4, line.replace("w5", "x").replace("w9", "y"), 0)]
    assert {r.doc_id for r in L.dedup(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 4}


def test_ends_that_alike_lines_share():
    """Any one edit leaves a common run of the stated length at the beginning or the end, under a key that both have."""
    import numpy as np

    lengths = lambda n: {int(L.half_of(np.int64(n)))} | ({int(L.half_of(np.int64(n - 1)))} if n % 8 == 0 else set())
    for n in range(5, 60):
        for other in (n, n - 1):
            common = lengths(n) & lengths(other)
            assert any(all(max(p, n - 1 - p) >= h for p in range(n)) for h in common), (n, other)


def test_rows_that_share_an_id_or_have_none(spark):
    rows = [(None, "x\ny", 0), (None, "z", 0), (None, "x\nq\nr", 0), (5, "one\ntwo\nthree", 0), (5, "four\ntwo", 0), (6, "three\nfour\nz", 0), (5, "four\ntwo", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id or 99), r.text) for r in L.dedup(df).collect())
    lines = [x for d, t in got if (d, t) != (5, "four\ntwo") for x in t.split("\n")]
    five = [t for d, t in got if d == 5]
    # each line once, but for those of the row that stands there twice
    assert set(lines) | {x for t in five for x in t.split("\n")} == {"x", "y", "z", "q", "r", "one", "two", "three", "four"}
    assert sum(t.split("\n").count("x") for _, t in got) == 1 and sum(t.split("\n").count("z") for _, t in got) == 1
    assert (6, "z") in got  # three and four come earlier, z of the row without an id later
    assert len({t for t in five}) == 2 and sum("two" in t.split("\n") for t in set(five)) == 1
    assert got == sorted(((r.doc_id or 99), r.text) for r in L.dedup(df.repartition(3)).collect())


def test_common_opening_and_very_long_lines(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_LINES", 20)
    rng = random.Random(9)
    rows = []
    for d in range(80):
        w = ["the", "same", "opening", "words", "of", *(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 9)))]
        rows.append((d, " ".join(w) + "\n" + " ".join(w[:-2] + ["changed"] + w[-1:]), 0))
    long = " ".join(f"v{k}" for k in range(30_000))
    rows += [(100, long, 0), (101, long.replace("v777 ", "other "), 0), (102, long.replace("v777 ", "").replace("v888 ", ""), 0)]
    got = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert 101 not in got and 102 in got
    assert got == {d: t for d, t in brute(rows[:80]).items()} | {100: long, 102: rows[-1][1]}
