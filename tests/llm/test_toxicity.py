import random
import re

import numpy as np
import pytest

from hexloom.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def kind_of(w, terms, words, root=False):
    near = lambda t, most: distance(w.encode(), t.encode()) <= min(most, X.tolerance(t.encode())) and (root or w.encode()[:1] == t.encode()[:1])
    return X.TERM if w in terms else X.WORD if w in words else X.NEAR_TERM if any(near(t, 2) for t in terms) else X.NEAR_WORD if any(near(t, 1) for t in words) else 0


@pytest.mark.parametrize("size", [2, 32])
def test_automata_against_brute_force(monkeypatch, size):
    monkeypatch.setattr(X, "TRIE_TERMS", size)
    terms, words = ["idiot", "moron", "bad", "disgusting", "idiom"], ["loweist", "loweié", "disguise"]
    a = X.Lexicon(terms, words)
    rng = random.Random(2)
    asked = []
    for _ in range(4000):
        w = list(rng.choice(terms + words))
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(w) + 1)
            w[p : p + rng.randrange(2)] = rng.choice([[], [rng.choice("abdegimnorsté")]])
        asked.append("".join(w) or "x")
    raw = "".join(asked).encode()
    size = np.array([len(w.encode()) for w in asked])
    end = np.cumsum(size)
    got = a.walk(np.frombuffer(raw, np.uint8), end - size, end)
    for w, k in zip(asked, got.tolist(), strict=True):
        assert k == kind_of(w, terms, words), (w, k)


def brute_features(text, m, clean):
    """The features of one text, word by word."""
    low = (text or "").lower()
    for q in X.QUOTES[1:]:
        low = low.replace(q, '"')
    spans = [(x.start(), x.end(), x[0]) for x in re.finditer("[a-z\u0080-\U0010ffff]+", low)]
    kinds = []
    for _, _, w in spans:
        k = kind_of(w, m.terms, m.words) or (X.LOOSE if kind_of(w, m.terms, [], root=True) else 0)
        kinds.append(0 if k > X.WORD and w in clean else k)
    for x in re.finditer(r'[^\x00-\x20"\x7f]+', low):
        solid = re.search("[a-z0-9\u0080-\U0010ffff](.*[a-z0-9\u0080-\U0010ffff])?", x[0])
        own = [i for i, (a, b, _) in enumerate(spans) if solid and a >= x.start() + solid.start() and b <= x.start() + solid.end()]
        if solid and own and re.search("[^a-z\u0080-\U0010ffff]", solid[0]) and not any(kinds[i] for i in own) and kind_of(solid[0], m.terms, [], root=True):
            kinds[own[0]] = X.LOOSE
    out = [0.0] * 6
    out[4] = len(spans)
    for i, k in enumerate(kinds):
        if k:
            lo, hi = max(0, i - X.WINDOW), min(len(spans) - 1, i + X.WINDOW)
            before = low[spans[lo][0] : spans[i][0]].count('"')
            after = low[spans[i][1] : spans[hi][1]].count('"') or low[spans[i][1] : spans[i][1] + 1] == '"'
            quoted = (before % 2 == 1 and after) or any(s[2] in m.reports for s in spans[lo : hi + 1])
            out[3 if quoted else X.COLUMN[k]] += 1
    return out


def test_end_to_end_against_brute_force(spark):
    """Scores of a trained model, from word-by-word features with plain edit distance."""
    rng = random.Random(8)
    plain = [f"{a}{b}" for a in ("haus", "tree", "idion", "wort", "run") for b in ("", "er", "ing", "s", "chen")]
    bad = ["idiot", "disgusting", "grobachet", "grobachung", "grobachlich", "grobachig"]
    say = lambda n: [rng.choice(plain) for _ in range(n)]
    rows, labels = [], []
    for d in range(240):
        w = say(rng.randrange(1, 25))
        toxic = d % 3 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        elif d % 12 == 1:
            w += ["they", "said", '"idiot"']
        rows.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = X.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "disgusting" in m.terms and {*bad} - {"idiot"} <= {*m.terms, *m.words}
    count = {}
    for (_, t), (_, y) in zip(rows, labels, strict=True):
        for w in set(re.findall("[a-z]+", t)):
            n, b = count.get(w, (0, 0))
            count[w] = (n + 1, b + y)
    clean = {w for w, (n, b) in count.items() if b < 0.5 * n}
    asked = [(k, t) for k, t in enumerate(["you idoit", "an 1diot!", "grobachbar und xdiot", 'he wrote "disgustng" to us', "tr33s haus", "idions", "", None, "«idiot»", "a disgusting," * 3000, "id-iot d1sgu5ting"])] + rows[:80]
    got = X.score(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(asked)], "doc_id long, text string"), m).orderBy("doc_id").collect()
    x = np.array([brute_features(t, m, clean) for _, t in asked])
    want = 1 / (1 + np.exp(-(X._design(x) @ m.weights)))
    assert [r.score for r in got] == pytest.approx(want.tolist(), abs=1e-9)
    y = np.array([b for _, b in labels], float)
    own = np.array([brute_features(t, m, clean) for _, t in rows])
    assert m.weights == pytest.approx(X._fit(own, y), abs=1e-6)
    assert m.support["families"][1] == int((own[y > 0, 2] > 0).sum())


def test_quotation_is_told_from_abuse():
    import pyarrow as pa

    m = X.Model(["idiot"])
    x = m.features(pa.array(["you idiot go away", 'she said "idiot" to him', "you idoit idiott", "plain", None, ""]))
    assert x[:, :4].tolist() == [[1, 0, 0, 0], [0, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = X.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    assert right >= 0.97 * len(rows) and caught >= 0.8
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(i, "you are an idiot" if i % 2 else "a fine day", 0.0) for i in range(20)] + [(30, None, 0.0), (31, "", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (None, 1), (99, 1), (30, None)], "doc_id long, toxic int")
    m = X.train(docs, labels)
    assert "idiot" in m.terms
    got = {r.doc_id: r.score for r in X.score(docs, m).collect()}
    assert len(got) == 22 and got[1] > 0.5 > got[0] and got[30] == got[31]
    none = X.train(docs, labels.limit(0))
    assert {r.score for r in X.score(docs, none).collect()} == {0.0}
    assert X.score(docs.limit(0), m).count() == 0


def test_first_letters_and_signs_against_unrestricted_distance():
    import pyarrow as pa

    terms = ["idiot", "moron", "trash", "bad", "disgusting"]
    a = X.Lexicon(terms, [], root=True)
    rng = random.Random(5)
    words = ["xdiot", "diot", "aidiot", "id1ot", "1diot", "m*ron", "tr@sh", "d1sgu5ting", "xisgustng"]
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(w) + 1) if rng.random() < 0.5 else 0
            w[p : p + rng.randrange(2)] = rng.choice([[], [rng.choice("abdegimnorst1@*")]])
        words.append("".join(w) or "x")
    end = np.cumsum([len(w) for w in words])
    got = a.walk(np.frombuffer("".join(words).encode(), np.uint8), end - [len(w) for w in words], end)
    for w, k in zip(words, got.tolist(), strict=True):
        assert k == kind_of(w, terms, [], root=True), (w, k)
    x = X.Model(terms).features(pa.array([f"you {w}, go" for w in words[:9]] + ["call 555 a.b now", "1 idiot-like"]))
    assert x[:, 5].tolist() == [1] * 9 + [0, 0] and x[:, :4].sum(axis=1).tolist() == [0] * 9 + [0, 1]


def test_ties_repeated_rows_and_columns_beside(spark):
    rows = [(i, "you idiot fool" if i % 2 else "a fine day", 0.5, "p") for i in range(30)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, 0)], "doc_id long, toxic int")
    m = X.train(docs, labels)
    again = X.train(docs.repartition(5), labels)
    assert (m.terms, m.words) == (again.terms, again.words)  # words that occur alike are chosen in one order
    out = X.score(docs, m)
    assert out.columns == ["doc_id", "predicted", "score"] and out.count() == 31
    assert len({r.score for r in out.collect()}) == 2
