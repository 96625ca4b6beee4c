"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is centred, rotated by one random orthogonal matrix and kept as the signs of its coordinates (packed
bits) with three correction scalars: the residual's norm, its inner product with its own code, and its inner product
with the centre. These codes are written once, beside the vectors, and read by every block of queries. A query is
rotated, too, and its coordinates are cut into ``LEVELS`` bit planes; its product with a code is a sum of counts of the
ones that plane and code share, a word of 64 coordinates at a time. From that an unbiased estimate of an inner product
and a bound on its error (of the code, by ``EPSILON``, and of the planes, exactly) follow; only vectors whose upper
bound reaches the k-th best found so far are scored exactly.

Queries are collected in blocks of at most ``BLOCK_BYTES`` and sent to all tasks; a block costs one scan of the
vectors and no shuffle of them. With the block goes each query's k-th best score among ``BAR_ROWS`` vectors, which the
result can't fall below: a task gives back no more than k rows per query, and only those that reach it; the best of the
``BAR_ROWS`` take part in the result themselves, so that no query has fewer than k.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with
a null id; vectors of different length are not compared; of rows that share an id the largest vector (in array order)
counts; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexloom.llm.common import scratch, written

BLOCK_BYTES, BAR_ROWS, LEVELS = 16 << 20, 4096, 8
EPSILON = 2.5
U = np.uint64
CODES = "vec_id long, embedding array<double>, bits binary, norm double, fit double, shift double"
SCHEMA = "query_id long, ids array<long>, scores array<double>"


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def packed(ones: np.ndarray) -> np.ndarray:
    """Rows of booleans as words of 64 bits, filled up with zeros."""
    raw = np.packbits(ones, axis=1)
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(U)


class Codes:
    """One-bit codes of some vectors: packed signs and correction scalars."""

    def __init__(self, bits: np.ndarray, norm: np.ndarray, fit: np.ndarray, shift: np.ndarray, d: int):
        self.bits, self.norm, self.fit, self.shift, self.d = bits, norm, fit, shift, d
        self.ones = np.bitwise_count(bits).sum(axis=1)

    @classmethod
    def of(cls, x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
        d = x.shape[1]
        r = (x - centre) @ turn.T
        norm = np.sqrt((r * r).sum(axis=1))
        unit = r / np.where(norm, norm, 1)[:, None]
        return cls(packed(unit > 0), norm, np.maximum(np.abs(unit).sum(axis=1) / np.sqrt(d), 1e-6), x @ centre, d)


class Planes:
    """Rotated queries in bit planes: coordinate i is ``low + step * (sum of its bits times 2^j)``, but for ``off`` in all."""

    def __init__(self, q: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        r = (q - centre) @ turn.T
        self.low = r.min(axis=1)
        self.step = np.maximum(r.max(axis=1) - self.low, 1e-300) / ((1 << LEVELS) - 1)
        level = np.rint((r - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        near = self.low[:, None] + self.step[:, None] * level
        self.planes = [packed(level >> j & 1 > 0) for j in range(LEVELS)]
        self.sum, self.off = near.sum(axis=1), np.abs(r - near).sum(axis=1)
        self.length = np.sqrt((r * r).sum(axis=1))
        self.shift = q @ centre - centre @ centre

    def products(self, codes: Codes) -> np.ndarray:
        """Products of the queries with the codes' signs (queries by vectors), up to ``off``."""
        total = np.zeros((len(self.low), len(codes.bits)), np.int32)
        for j, plane in enumerate(self.planes):
            for k in range(plane.shape[1]):
                total += np.bitwise_count(plane[:, k, None] & codes.bits[None, :, k]).astype(np.int32) << j
        with_ones = total * self.step[:, None].astype(np.float32) + self.low[:, None].astype(np.float32) * codes.ones.astype(np.float32)
        return 2 * with_ones - self.sum[:, None].astype(np.float32)


def estimates(codes: Codes, planes: Planes, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries by vectors) and bounds on their errors."""
    d = codes.d
    scale = codes.norm / (codes.fit * np.sqrt(d))
    est = planes.products(codes) * scale.astype(np.float32)
    est += codes.shift.astype(np.float32)
    est += planes.shift[:, None].astype(np.float32)
    spread = codes.norm * np.sqrt(np.maximum(1 - codes.fit**2, 0)) / codes.fit * epsilon / np.sqrt(max(d - 1, 1))
    err = np.outer(planes.length, spread) + np.outer(planes.off, scale)
    return est, err.astype(np.float32) + np.float32(1e-4) * np.abs(est)


def _valid(df: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(float("nan"))) * F.coalesce(x, F.lit(float("nan")))))
    d = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(finite).filter(size > 0)
    return d.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))


def _matrix(rows: pa.Table | pa.RecordBatch, d: int) -> np.ndarray:
    column = rows.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _coder(d: int, centre: np.ndarray, turn: np.ndarray):
    """The map from vectors to their codes; centre and rotation are as long as a vector, and its square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Codes.of(_matrix(batch, d), centre, turn)
            bits = pa.array([b.tobytes() for b in c.bits], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), bits, *map(pa.array, (c.norm, c.fit, c.shift))], names=["vec_id", "embedding", "bits", "norm", "fit", "shift"])

    return run


def search(df: DataFrame, is_query, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` vectors with the largest inner product for every row where ``is_query`` holds."""
    with scratch():
        return _search(df, is_query, k, block_bytes)


def _search(df: DataFrame, is_query, k: int, block_bytes: int) -> DataFrame:
    vectors = written(_valid(df), "vectors")
    sizes = vectors.groupBy(F.size("embedding").alias("d")).agg(F.sum(F.when(is_query, 1).otherwise(0)).alias("q"), F.count("*").alias("n")).collect()
    parts = []
    for row in sizes:
        d, here = row["d"], vectors.filter(F.size("embedding") == row["d"])
        if not row["q"]:
            continue
        sums = here.select(*[F.avg(F.col("embedding")[j].cast("double")).alias(f"c{j}") for j in range(d)]).first()
        centre, turn = np.array(sums, np.float64), rotation(d)
        coded = written(here.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_coder(d, centre, turn), CODES), "codes")
        sample = here.select(F.col("embedding").cast("array<double>").alias("embedding"), "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(BAR_ROWS).toArrow()
        some = sample.column("vec_id").to_numpy(), _matrix(sample, d)
        blocks = -(-row["q"] * d * 8 // block_bytes)
        for b in range(blocks):
            asked = coded.filter(is_query).filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("embedding", "vec_id").toArrow()
            if not asked.num_rows:
                continue
            ids, q = asked.column("vec_id").to_numpy(), _matrix(asked, d)
            first = _best_of(ids, q, *some, k)
            bars = np.array([s[-1] if len(s) == k else -np.inf for _, s in first])
            known = pa.table({"query_id": ids, "ids": pa.array([i for i, _ in first], pa.list_(pa.int64())), "scores": pa.array([s for _, s in first], pa.list_(pa.float64()))})
            found = _scan(coded, ids, q, bars, centre, turn, k).unionByName(df.sparkSession.createDataFrame(known, SCHEMA))
            parts.append(written(found, "near") if blocks > 1 else found)
    if not parts:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    pairs = out.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("query_id", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.distinct()  # what is among the first vectors was found again by a task
    return written(pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest", keep=True)


def _best_of(ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each query's ``k`` nearest of some vectors, exactly: ids and scores."""
    out = []
    for a in range(0, len(q), 512):
        near = q[a : a + 512] @ x.T
        near[ids[a : a + 512, None] == own[None, :]] = -np.inf
        top = np.argsort(-near, axis=1, kind="stable")[:, : k + 8]  # a few more, as that sum is rounded otherwise
        for i, row in enumerate(top):
            row = row[own[row] != ids[a + i]]
            score = _products(q[a + i : a + i + 1].T, x.T, np.zeros(len(row), np.int64), row)
            order = np.lexsort((own[row], -score))[:k]
            out.append((own[row][order], score[order]))
    return out


def _scan(coded: DataFrame, ids: np.ndarray, q: np.ndarray, bars: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    sent = coded.sparkSession.sparkContext.broadcast((ids, q, bars, centre, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, bars, centre, turn = sent.value
        planes = [Planes(q[a : a + 256], centre, turn) for a in range(0, len(q), 256)]
        across = np.ascontiguousarray(q.T)
        best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        best = np.repeat(bars[:, None], k, axis=1)  # places held by the bar have no id
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), U).reshape(part.num_rows, -1)
                codes = Codes(bits, *(part.column(c).to_numpy() for c in ("norm", "fit", "shift")), q.shape[1])
                x = np.ascontiguousarray(_matrix(part, q.shape[1]).T)
                _merge(part.column("vec_id").to_numpy(), x, codes, ids, across, planes, k, best_id, best)
        for at in range(0, len(ids), 4096):
            i, s = best_id[at : at + 4096], best[at : at + 4096]
            full = i < np.iinfo(np.int64).max
            own = full.any(axis=1)
            i, s, full, who = i[own], s[own], full[own], ids[at : at + 4096][own]
            offsets = np.concatenate([[0], np.cumsum(full.sum(axis=1))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[full])) for x in (i, s)]
            yield pa.RecordBatch.from_arrays([pa.array(who), *lists], names=["query_id", "ids", "scores"])

    return coded.mapInArrow(run, SCHEMA)


def _merge(vid, x, codes, ids, q, planes, k, best_id, best) -> None:
    """Bring vectors into the best lists, exact scores only for those that the bounds let through. ``x`` and ``q`` have a
    vector in each column."""
    for a in range(0, len(ids), 256):
        est, err = estimates(codes, planes[a // 256])
        rows, cols = np.nonzero(ids[a : a + 256, None] == vid[None, :])
        est[rows, cols] = -np.inf
        if len(vid) > 2 * k:  # exact scores of the best estimates first: they set the bar for all others
            top = np.argpartition(est, len(vid) - k, axis=1)[:, len(vid) - k :]
            rows = np.repeat(np.arange(len(est)), k)
            real = est[rows, top.ravel()] > -np.inf
            _score(a, rows[real], top.ravel()[real], vid, x, q, best_id, best, k)
            err[rows, top.ravel()] = -np.inf
        est += err
        bar = best[a : a + 256, -1].astype(np.float32)
        rows, cols = np.nonzero((est >= (bar - np.abs(bar) * np.float32(1e-5))[:, None]) & (est > -np.inf))
        for lo in range(0, len(rows), 1 << 16):
            _score(a, rows[lo : lo + (1 << 16)], cols[lo : lo + (1 << 16)], vid, x, q, best_id, best, k)


def _score(a, rows, cols, vid, x, q, best_id, best, k) -> None:
    exact = _products(q, x, a + rows, cols)
    good = (exact >= best[a + rows, -1])
    _insert(a + rows[good], vid[cols[good]], exact[good], best_id, best, k)


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of columns ``i`` of ``a`` with columns ``j`` of ``b``, added up in the order of the components, as
    any plain loop does."""
    out = np.zeros(len(i))
    for x, y in zip(a, b, strict=True):
        out += x[i] * y[j]
    return out


def _insert(row, vid, score, best_id, best, k) -> None:
    if not len(row):
        return
    touched = np.unique(row)
    all_row = np.concatenate([np.repeat(touched, k), row])
    all_id = np.concatenate([best_id[touched].ravel(), vid])
    all_score = np.concatenate([best[touched].ravel(), score])
    order = np.lexsort((all_id, -all_score, all_row))
    all_row, all_id, all_score = all_row[order], all_id[order], all_score[order]
    first = np.searchsorted(all_row, touched)
    take = (first[:, None] + np.arange(k)[None, :]).ravel()
    best_id[touched] = all_id[take].reshape(-1, k)
    best[touched] = all_score[take].reshape(-1, k)


def query(spark, sf_dir: str) -> DataFrame:
    """``op7_vector_search``: queries are the rows whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


SQL = """
WITH valid AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score
  FROM valid q JOIN valid c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""
