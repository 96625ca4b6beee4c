import collections
import math
import random
import re

import pytest

from hexloom.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = L.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(out) > 100
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_backoff_and_defined_cases(spark):
    rows = [(i, "the cat and the dog", "en", 1) for i in range(4)] + [(10 + i, "le chat et le chien chienne", "fr", 1) for i in range(4)] + [(20, "der hund", None, 1)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_score int")
    model = L.train(train)
    assert model.langs == ["en", "fr"]
    asked = [(1, "the dog"), (2, "chat chien"), (3, "chiens"), (4, None), (5, ""), (6, "123 ..."), (7, "dogs cats"), (7, "dogs cats")]
    got = [(r.doc_id, r.lang_pred, r.lang_score) for r in L.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()]
    assert {(d, p) for d, p, _ in got} == {(1, "en"), (2, "fr"), (3, "fr"), (4, "und"), (5, "und"), (6, "und"), (7, "en")}
    assert len(got) == 8 and all(s == 0 for d, _, s in got if d in (4, 5, 6))
    empty = L.train(train.limit(0))
    assert empty.langs == []
    assert {r.lang_pred for r in L.predict(spark.createDataFrame(asked, "doc_id long, text string"), empty).collect()} == {"und"}
    assert L.predict(train.limit(0), model).count() == 0


def test_rare_language_is_learned_whole(spark):
    rows = [(i, f"the cat number{i % 9} and the dog", "en") for i in range(900)] + [(2000 + i, "kissa ja koira talossa", "fi") for i in range(6)] + [(3000, "123", "zz")]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=30)
    assert model.langs == ["en", "fi"]  # nothing is known of zz
    got = L.predict(spark.createDataFrame([(1, "koira ja kissa"), (2, "the dog")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "fi", 2: "en"}
    share = L.stratified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", 30).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in share}["fi"] == 6


def brute(rows, texts):
    """Word-first backoff as described, with dictionaries."""
    cut = lambda t: re.findall(r"[a-z\u0080-\U0010ffff]+", (t or "").lower())
    grams = lambda w, n: [w[i : i + n] for i in range(len(w) - n + 1)]
    counts = [collections.defaultdict(collections.Counter) for _ in range(6)]
    langs = sorted({lang for _, lang in rows if lang})
    for text, lang in rows:
        if lang and text:
            counts[0][lang].update(cut(text))
    for lang in langs:  # n-grams of a language's distinct words
        for w in counts[0][lang]:
            for n in range(1, 6):
                counts[n][lang].update(grams(w, n))
    known = [set().union(*(counts[n][x] for x in langs)) for n in range(6)]
    total = [{x: sum(counts[n][x].values()) for x in langs} for n in range(6)]
    log = lambda n, x, e: math.log((counts[n][x][e] + 0.1) / (total[n][x] + 0.1 * max(1, len(known[n]))))
    for text in texts:
        sums = dict.fromkeys(langs, 0.0)
        for w in cut(text):
            for n in (0, 5, 4, 3, 2, 1):
                hit = [e for e in ([w] if n == 0 else grams(w, n)) if e in known[n]]
                if hit:
                    for x in langs:
                        sums[x] += sum(log(n, x, e) for e in hit) / len(hit)
                    break
        best = max(langs, key=lambda x: (sums[x], [-ord(c) for c in x]))
        sure = 1 / sum(math.exp(min(v - sums[best], 0)) for v in sums.values())
        yield (best, sure) if re.search(r"[^\W\d_]", text or "") else ("und", 0.0)


def test_against_brute_force(spark):
    rng = random.Random(2)
    spell = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 8)))
    own = {"aa": "abcdeé", "bb": "defgüh", "cc": "ghijабв"}
    words = {x: [spell(s) for _ in range(25)] for x, s in own.items()}
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    rows = [(k, say(x, 1 + rng.randrange(20)), x) for k, x in enumerate(rng.choices([*own], k=40))] + [(99, "zz", None), (98, None, "aa")]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(1))
    asked = [" ".join(spell(own[x]) for _ in range(rng.randrange(6))) for x in rng.choices([*own], k=60)] + [say(x, 9).upper() for x in own] + ["", "12 3", "qqq", "ж", None]
    got = [(r.lang_pred, r.lang_score) for r in L.predict(spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "doc_id long, text string"), model).orderBy("doc_id").collect()]
    want = list(brute([(t, x) for _, t, x in rows], asked))
    for t, g, v in zip(asked, got, want, strict=True):
        assert g[1] == pytest.approx(v[1], abs=1e-4), t
        if v[1] > 0.6 or v[0] == "und":
            assert g[0] == v[0], t


def test_many_values_of_lang_and_all_entries_count(spark):
    """No entry of the sample is cut off, however many languages and words there are."""
    rows = [(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)), f"l{k:04}") for k in range(400)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 400 and len(model.keys[0]) == 400 * 40
    got = L.predict(spark.createDataFrame([(k, t.split()[7]) for k, t, _ in rows], "doc_id long, text string"), model).collect()
    assert all(r.lang_pred == f"l{r.doc_id:04}" for r in got)


def test_stage_keeps_columns_and_long_texts(spark):
    text = "the cat and the dog " * 20_000
    rows = [(k, "the cat and the dog", "en", "mine", 5) for k in range(5)] + [(9, text, "en", None, 6), (10, "123", "en", "x", 7), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, lang_score int")
    out = L.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.lang_pred or "", r.lang_score) for r in out.collect()) == [*((k, "mine", 5) for k in range(5)), (9, "", 6)]
    assert L.stage(spark, docs.limit(0), "").count() == 0


def test_ties_go_to_the_language_that_sorts_first(spark):
    rows = [(1, "same words", "zz"), (2, "same words", "aa"), (3, "same words", "mm")]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    (r,) = L.predict(spark.createDataFrame([(1, "same words same")], "doc_id long, text string"), model).collect()
    assert r.lang_pred == "aa" and r.lang_score == pytest.approx(1 / 3)
