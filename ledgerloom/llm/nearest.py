"""Nearest vectors by score-aware quantisation, four-bit table scans and exact reranking.

Euclidean distance becomes an inner product: the nearest x has the largest
q.x - |x|^2 / 2.  The inner product is estimated from product-quantised
vectors whose codebooks minimise an anisotropic loss: the part of a residual
that is parallel to its vector costs more than the rest, since it is what moves
large inner products.  The norm term is kept exactly.  A scan adds up, for each
vector, two table entries at a time (two four-bit codes make a byte); the best
of every shard are then measured exactly, in double precision.

All vectors are indexed, in shards of a fixed size; queries go in blocks of a
fixed size; a task sees one shard and one block.  Codebooks are fitted on at
most SAMPLE vectors.

Defined cases: vectors that are null, zero, of another length than most, or
hold null or non-finite components, and rows without an id, take no part; rows
that repeat an id are one vector (the least, should they differ); ties go to
the smaller id; with fewer candidates than asked, all come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frame, materialize

SAMPLE = 20_000
SUBSPACE = 2
#: How much more a parallel residual costs, from a threshold on the cosine of 0.2.
THRESHOLD = 0.2
SHARD = 16_384
QUERY_BLOCK = 512
#: Vectors of a shard that are measured exactly for each query.
RERANK = 640


class AnisotropicQuantizer:
    """Sixteen centroids for every two coordinates."""

    def __init__(self, sample: np.ndarray, rounds: int = 8, seed: int = 5):
        n, d = sample.shape
        self.d = d
        self.m = -(-d // SUBSPACE)
        self.m += self.m % 2  # codes come in pairs
        self.eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        x = self._split(sample)
        rng = np.random.default_rng(seed)
        pick = rng.integers(0, n, (self.m, 16))
        self.centroids = np.stack([x[pick[k], k] for k in range(self.m)]) + 1e-6 * rng.standard_normal((self.m, 16, SUBSPACE))
        codes = self._nearest(x)
        for _ in range(rounds):
            self._update(x, codes)
            codes = self.encode_split(x, codes, sweeps=1)

    def _split(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(v), self.m * SUBSPACE))
        out[:, : v.shape[1]] = v
        return out.reshape(len(v), self.m, SUBSPACE)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        return np.stack(
            [((x[:, k, None, :] - self.centroids[k][None]) ** 2).sum(axis=2).argmin(axis=1) for k in range(self.m)], axis=1
        )

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x**2).sum(axis=(1, 2), keepdims=True)), 1e-30)

    def _update(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each subspace's centroids in turn, by the weighted normal equations of the loss."""
        u = self._unit(x)
        r = x - self.centroids[np.arange(self.m), codes]
        parallel = (u * r).sum(axis=(1, 2))
        eye = np.eye(SUBSPACE)
        for k in range(self.m):
            others = parallel - (u[:, k] * r[:, k]).sum(axis=1)
            a = eye + (self.eta - 1) * u[:, k, :, None] * u[:, k, None, :]
            b = x[:, k] + (self.eta - 1) * u[:, k] * (others + (u[:, k] * x[:, k]).sum(axis=1))[:, None]
            c = codes[:, k]
            for j in range(16):
                mine = c == j
                if mine.any():
                    self.centroids[k, j] = np.linalg.solve(a[mine].sum(axis=0) + 1e-9 * eye, b[mine].sum(axis=0))
            r[:, k] = x[:, k] - self.centroids[k, c]
            parallel = others + (u[:, k] * r[:, k]).sum(axis=1)

    def encode_split(self, x: np.ndarray, codes: np.ndarray, sweeps: int) -> np.ndarray:
        """Coordinate descent on the loss, one subspace after another."""
        u = self._unit(x)
        codes = codes.copy()
        r = x - self.centroids[np.arange(self.m), codes]
        parallel = (u * r).sum(axis=(1, 2))
        for _ in range(sweeps):
            for k in range(self.m):
                others = parallel - (u[:, k] * r[:, k]).sum(axis=1)
                e = x[:, k, None, :] - self.centroids[k][None]
                p = (u[:, k, None, :] * e).sum(axis=2)
                loss = (e**2).sum(axis=2) + (self.eta - 1) * (others[:, None] + p) ** 2
                codes[:, k] = loss.argmin(axis=1)
                at = np.arange(len(x))
                r[:, k] = e[at, codes[:, k]]
                parallel = others + p[at, codes[:, k]]
        return codes

    def encode(self, v: np.ndarray) -> np.ndarray:
        """Two codes to a byte: [n, m / 2]."""
        x = self._split(v)
        c = self.encode_split(x, self._nearest(x), sweeps=2).astype(np.uint8)
        return c[:, 0::2] | (c[:, 1::2] << 4)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with every pair of centroids: [queries, m / 2, 256]."""
        t = np.einsum("qms,mcs->qmc", self._split(q), self.centroids)
        low, high = t[:, 0::2], t[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), self.m // 2, 256).astype(np.float32)


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v) of the vectors that take part, as arrays of doubles of the commonest length."""
    v = F.col(column).cast("array<double>")
    big = F.lit(float("inf"))
    fine = (
        F.col(id_column).isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.filter(fine).select(F.col(id_column).alias("id"), v.alias("v"))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (top["d"] if top else 0))


def _pack(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their vectors; repeated ids once."""
    v = np.stack(b["v"].to_numpy())
    ids = b["id"].to_numpy(dtype=np.int64)
    order = np.lexsort((*v.T[::-1], ids))
    ids, v = ids[order], v[order]
    new = np.r_[True, ids[1:] != ids[:-1]]
    return ids[new], np.ascontiguousarray(v[new])


def _collapse(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal vectors once: their ids side by side in order, where each run starts, and the vectors.

    So a vector that very many rows share takes one place among the candidates.
    """
    order = np.lexsort((ids, *v.T[::-1]))
    ids, v = ids[order], v[order]
    start = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]).any(axis=1)])
    return ids, start, np.ascontiguousarray(v[start])


def search_block(
    quantizer: AnisotropicQuantizer, ids: np.ndarray, start: np.ndarray, v: np.ndarray, codes: np.ndarray,
    q_ids: np.ndarray, q: np.ndarray, k: int, rerank: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the best of one shard for each query of a block."""
    tables = quantizer.tables(q)
    score = np.repeat(-(v**2).sum(axis=1)[None, :].astype(np.float32) / 2, len(q), axis=0)
    for j in range(codes.shape[1]):
        score += tables[:, j][:, codes[:, j]]
    end = np.r_[start[1:], len(ids)]
    take = min(rerank, len(v))
    out = []
    for i in range(len(q)):
        at = np.argpartition(-score[i], take - 1)[:take]
        dist = np.sqrt(((v[at] - q[i]) ** 2).sum(axis=1))
        size = np.minimum(end[at] - start[at], k + 1)  # smaller ids first; one may be the query's own
        each = np.repeat(start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        near, far = ids[each], np.repeat(dist, size)
        other = near != q_ids[i]
        near, far = near[other], far[other]
        best = np.lexsort((near, far))[:k]
        out.append((np.full(len(best), q_ids[i]), near[best], far[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", column: str = "embedding", rerank: int = RERANK
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, column)
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    quantizer = AnisotropicQuantizer(np.unique(np.array([r["v"] for r in sample]), axis=0))
    shards, d = -(-total // SHARD), quantizer.d
    queries = rows.filter(is_query)
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], schema)
    blocks = -(-n_queries // QUERY_BLOCK)

    def pack_index(b: pd.DataFrame) -> pd.DataFrame:
        ids, start, v = _collapse(*_pack(b))
        return frame(
            shard=[int(b["shard"].iloc[0])], ids=[ids.tobytes()], start=[start.tobytes()],
            v=[v.tobytes()], codes=[quantizer.encode(v).tobytes()],
        )

    def pack_queries(b: pd.DataFrame) -> pd.DataFrame:
        ids, v = _pack(b)
        return frame(q_ids=[ids.tobytes()], q=[v.tobytes()])

    index = materialize(
        rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        .groupBy("shard").applyInPandas(pack_index, "shard int, ids binary, start binary, v binary, codes binary"),
        "vector-index",
    )
    packed = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    packed = packed.groupBy("block").applyInPandas(pack_queries, "q_ids binary, q binary")
    pairs = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(index, "shard")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids, q_ids = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.q_ids, dtype=np.int64)
                start = np.frombuffer(r.start, dtype=np.int64)
                v, q = np.frombuffer(r.v).reshape(-1, d), np.frombuffer(r.q).reshape(-1, d)
                codes = np.frombuffer(r.codes, dtype=np.uint8).reshape(len(v), -1)
                a, i, s = search_block(quantizer, ids, start, v, codes, q_ids, q, k, rerank)
                yield frame(query_id=a, vec_id=i, score=s)

    found = pairs.mapInPandas(scan, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")  # k rows of each shard
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
