"""The pipeline on a small fixture, stage by stage against brute force."""

import random

import sentencepiece

import corpus_pipeline
from hexloom.llm import decontaminate, sentencepiece_codec
from tests.llm import test_decontaminate, test_jaccard_join, test_line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, path):
    rng = random.Random(11)
    vocab = {"en": [f"the{k}" for k in range(50)], "fr": [f"eau{k}" for k in range(50)]}
    item = [f"bench{k}" for k in range(30)]
    rows = []
    for d in range(60):
        lang = rng.choice(["en", "fr"])
        lines = [" ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(3, 30))) for _ in range(rng.randrange(1, 4))]
        if d % 12 == 0:
            lines.append(" ".join(item[15:] + item[:15]))
        if d % 9 == 1:
            base = rows[0][1].split()
            base[rng.randrange(len(base))] = "changed"
            lines = [" ".join(base)]
        text = "\n".join(lines)
        rows.append((d, text, lang, f"s{d % 3}", len(text)))
    rows += [(90, None, None, None, None), (91, "", "en", "s", 0), (92, "123 456", "en", "s", 7)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, item


def test_stages(spark, tmp_path):
    rows, item = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "sentencepiece"]
    had = {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert out.schema.simpleString() == docs.schema.simpleString()
        got = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            want = {d for d, r in had.items() if d < 90}
            assert set(got) == want
        elif name == "line_dedup":
            assert {d: r.text for d, r in got.items()} == test_line_dedup.brute([(r[0], r[1], 0) for r in had.values()])
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "jaccard_join":
            assert set(got) == {c for _, _, c in test_jaccard_join.brute([(r[0], r[1]) for r in had.values()])}
        elif name == "decontaminate":
            leaky = {d for d, r in had.items() if sum(t[2] for t in test_decontaminate.brute(item, r[1].split(), 5)) >= decontaminate.COVERAGE * len(item)}
            assert leaky and set(got) == set(had) - leaky
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
            assert {d: r.token_ids for d, r in got.items()} == {d: sp.encode(r[1]) for d, r in had.items()}
        had = {d: (d, r.text) for d, r in got.items()}
        docs = spark.createDataFrame(out.collect(), out.schema)
    whole = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == set(had)


def test_nothing_but_the_result_is_left(spark, tmp_path):
    import os

    from hexloom.sources.shared import shared_dir

    fixture(spark, str(tmp_path))
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("sentencepiece-")


def test_empty_tables_long_texts_and_columns_beside(spark, tmp_path):
    rows = [(k, f"the{k} fine words of text number {k * k} stand here", "en", "s", 7, "a", 1.5) for k in range(12)]
    rows.append((50, " ".join(f"some long{k % 3000} words" for k in range(30_000)), "en", "s", 1, None, None))
    rows += [(None, "a row without any id at all here", "en", None, None, "b", 2.5), (51, None, None, None, None, None, None)]
    schema = SCHEMA + ", lang_pred string, component_id double"
    for name, some in (("full", rows), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "component_id", "token_ids"]
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == (14 if some else 0)
        if some:
            assert got[3].lang_pred == "a" and got[None].component_id == 2.5 and len(got[50].token_ids) > 90_000
