import numpy as np
import pytest
from pyspark.sql import functions as F

from hexloom.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, asked, k):
    out = {}
    for q in asked:
        score = (x[ids == q][0] * x).sum(axis=1)
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-score[i], ids[i]))[:k]
        out[q] = [(int(ids[i]), score[i]) for i in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 32)).astype(np.float32)
    x[100:130] = x[100]
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    got = {}
    for r in vector_search.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(np.arange(900), x.astype(np.float64), range(0, 900, 20), 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, best in want.items():
        assert sorted(got[q]) == list(range(1, 21))
        own = [got[q][r] for r in range(1, 21)]
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))
        hits += len({v for v, _ in own} & {v for v, _ in best})
        assert all(s == pytest.approx(float((x[q].astype(float) * x[v].astype(float)).sum()), abs=1e-12) for v, s in own)
    assert hits >= 0.97 * 20 * len(want)


def test_recall_on_clusters(spark):
    """Vectors of other lengths, in tight clusters away from the origin, some of one sign only."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 70)) * 3 + 2
    x = (centres[rng.integers(0, 12, 1500)] + 0.3 * rng.standard_normal((1500, 70))) * rng.uniform(0.2, 3, 1500)[:, None]
    x[1000:1200] = np.abs(x[1000:1200])
    x = x.astype(np.float32)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in enumerate(x)], SCHEMA).repartition(3)
    got = {}
    for r in vector_search.search(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(np.arange(1500), x.astype(np.float64), range(0, 1500, 20), 20)
    assert all(len(got[q]) == 20 for q in want)
    assert sum(len(set(got[q]) & {v for v, _ in best}) for q, best in want.items()) >= 0.9 * 20 * len(want)


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.filter("embedding IS NOT NULL").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in vector_search.query(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x[ids % 20 == 0] @ x.T
    hits = 0
    for row, q in zip(score, ids[ids % 20 == 0], strict=True):
        row[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.argsort(-row)[:20]].tolist()))
        assert len(got[q]) == 20
    assert hits >= 0.95 * 20 * len(score)


def test_estimates_keep_to_their_bounds():
    rng = np.random.default_rng(9)
    x, q = rng.standard_normal((3000, 70)) + 0.5, rng.standard_normal((40, 70))
    centre, turn = x.mean(axis=0), vector_search.rotation(70)
    codes, planes = vector_search.Codes.of(x, centre, turn), vector_search.Planes(q, centre, turn)
    signs = np.unpackbits(codes.bits.view(np.uint8), axis=1, count=70) * 2.0 - 1
    exact = ((q - centre) @ turn.T) @ signs.T
    assert (np.abs(planes.products(codes) - exact) <= planes.off[:, None] + 1e-3).all()
    est, err = vector_search.estimates(codes, planes)
    assert (np.abs(est - q @ x.T) <= err).mean() > 0.98


def test_ties_and_columns_beside(spark):
    rows = [(i, [1.0, 0.0], 5, 0.5) for i in range(30)] + [(40, [2.0, 0.0], 5, 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")
    got = vector_search.search(df, F.col("vec_id") == 20, 3).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 40, 2.0), (2, 0, 1.0), (3, 1, 1.0)]


def test_blocks_of_queries_give_the_same(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist(), 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = {tuple(r) for r in vector_search.search(df, F.col("vec_id") % 20 == 0, 5).collect()}
    many = {tuple(r) for r in vector_search.search(df, F.col("vec_id") % 20 == 0, 5, block_bytes=200).collect()}
    assert one == many and len(one) == 50


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 1), (5, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (6, [1.0, 2.0], None), (6, [1.0, 2.0], 1), (7, [1.0], 1), (8, [], 1), (9, [1.0, 5.0], 1)]
    got = vector_search.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 6, 1.0), (0, 2, 9, 1.0)]


def test_empty(spark):
    got = vector_search.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0, 20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 0
