import random
import struct

import pyarrow as pa
import pytest
import sentencepiece

from hexloom.llm import sentencepiece_codec as S

TEXTS = ["", " ", "  a  b ", "\n\n x", "日本語 🎉 é", "<s> </s> <unk>", "▁a ▁", "aaa aaaa aaaaaaa", "\tx\r\n", "The quick brown fox. " * 50, "ﬁ ｆｕｌｌ Å", "a\u0000b", "don't   stop", "0x41 <0x41>"]


def test_parity_on_odd_texts():
    assert S.parity(TEXTS) == []


def test_parity_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    assert S.parity([r.text for r in rows if r.text is not None]) == []


def test_random_round_trip():
    rng = random.Random(1)
    chars = "abc  \n▁éß日🎉<>"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(400)]
    assert S.parity(texts) == []
    codec = S.codec()
    ids, at = codec.encode(pa.array(texts))
    want = [t.replace("▁", " ") for t in texts]
    assert [b.decode() for b in codec.decode(ids, at)] == want


def _varint(n):
    out = b""
    while True:
        n, b = n >> 7, n & 127
        out += bytes([b | (128 if n else 0)])
        if not n:
            return out


def _model(pieces, kind, dummy, extra, fallback):
    part = lambda n, body: _varint(n << 3 | 2) + _varint(len(body)) + body
    flag = lambda n, v: _varint(n << 3) + _varint(int(v))
    out = b""
    for p, score, t in pieces:
        out += part(1, part(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + flag(3, t))
    out += part(2, flag(3, kind) + flag(35, fallback) + flag(4, len(pieces)))
    return out + part(3, part(1, b"identity") + flag(3, dummy) + flag(4, extra) + flag(5, True))


def _same(tmp_path, pieces, kind, dummy, extra, fallback, texts):
    path = tmp_path / "own.model"
    path.write_bytes(_model(pieces, kind, dummy, extra, fallback))
    theirs = sentencepiece.SentencePieceProcessor(model_file=str(path))
    codec = S.Codec(path.read_bytes())
    ids, at = codec.encode(pa.array(texts))
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == theirs.encode(text), text


WORDS = ["▁the", "▁", "he", "t", "h", "e", "▁c", "at", "a", "c", "▁cat", "th", "s", "▁▁"]
SIGNS = ["<", ">", "/", "0", "x", "4", "1", "u"]


def _pieces(fallback, symbols=(), missing=()):
    out = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        out += [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    out += [(p, 0.0, 4) for p in symbols]
    return out + [(p, -1.0 - 0.37 * k, 1) for k, p in enumerate(WORDS + [s for s in SIGNS if s not in missing])]


@pytest.mark.parametrize(("dummy", "extra", "fallback"), [(True, False, False), (True, True, False), (False, False, True), (True, True, True)])
def test_a_unigram_model(tmp_path, dummy, extra, fallback):
    texts = ["the cat", " the  cats", "hat", "thecat at the", "cat  ", "", " ", "\ta\n"]
    texts += ["the <s> cat", "</s>", "<0x41> he", "<unk>the<s>", "a<s>"] + (["zé the", "é<0x41>é", "🎉🎉 cat"] if fallback else [])
    _same(tmp_path, _pieces(fallback), 1, dummy, extra, fallback, texts)
    _same(tmp_path, _pieces(fallback, missing="<0"), 1, dummy, extra, fallback, texts)


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize(("dummy", "extra"), [(True, False), (True, True), (False, False)])
def test_user_symbols(tmp_path, kind, dummy, extra):
    texts = ["<u1> the", "<u1>", "the<u1>cat", " <u1> <u12>  the ", "<u12><u1>cat", "the <s> <0x41> <u1", "zé<u1>", "", "cat"]
    _same(tmp_path, _pieces(True, ["<u1>", "<u12>"]), kind, dummy, extra, True, texts)


def test_control_strings_are_text_under_bpe(tmp_path):
    _same(tmp_path, _pieces(True), 2, True, False, True, ["<s> the </s>", "<0x41>", "<unk>", "zé <s>"])


def test_very_long_text():
    text = " ".join(f"word{k % 977}é" for k in range(60_000))
    assert S.parity([text, "a" * 5_000]) == []


def test_frames(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "", 7), (3, "", 7)], "doc_id long, text string, token_ids int")
    out = {r.doc_id: r for r in S.decode(S.encode(df)).collect()}
    assert out[1].decoded == "a b" and out[2].token_ids is None and out[2].decoded is None and out[3].token_ids == []
    rows = S.digests(df.select("doc_id", "text")).collect()
    assert len(rows) == 4 and all(r.round_trip for r in rows) and {r.n_tokens for r in rows if r.doc_id != 1} == {0}
    assert S.digests(df.limit(0)).count() == 0
    assert S.encode(df.limit(0)).count() == 0 and S.decode(S.encode(df.limit(0))).count() == 0
