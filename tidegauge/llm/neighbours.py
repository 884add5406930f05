"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Rows lie in blocks of bounded bytes, which stay where they are. In a block every vector, taken from
the block's centroid and turned by a random rotation, is coded by the signs of its components; two
numbers correct the code, its length and its inner product with the unit vector. Packed bits and
corrections give an unbiased estimate of every inner product and a bound of its error. The best by
estimate are computed exactly, and so is every row whose upper bound reaches the last of these.
Queries travel to the blocks in parts of bounded bytes, one pass over the blocks each; a task
merges what its blocks find for a query.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import col, cut_lineage
from tidegauge.llm.vectors import finite, matrices, nonzero

BLOCK_BYTES = 8 << 20
QUERY_BYTES = 64 << 20  # of the queries that every task holds in one pass
LEAST_BLOCK_ROWS = 512
ERROR_FACTOR = 2.5  # standard errors of the estimate that a bound allows for
_SUB_ROWS = 128  # queries whose estimates are held at once

_BLOCK = "dim int, ids binary, vectors binary, codes binary, scalars binary, centre binary"
_FOUND = "query_id long, query_key long, vec_id long, score double"


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _scale(vectors: np.ndarray) -> float:
    """The largest component; what is divided by it neither over- nor underflows in single precision sums."""
    return float(np.abs(vectors).max(initial=0)) or 1.0


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, lengths and corrections, centroid) of a block, in units of its largest component."""
    vectors = vectors / _scale(vectors)
    centre = vectors.mean(axis=0)
    turned = (vectors - centre) @ rotation(vectors.shape[1]).T
    length = np.sqrt(np.einsum("ij,ij->i", turned, turned))
    signs = turned > 0
    spread = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])  # code times vector
    right = np.where(length > 0, spread / np.maximum(length, 1e-300), 1.0)
    return np.packbits(signs, axis=1), np.stack([length, right]), centre


def estimate(codes, scalars, centre, dim: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (query by row), and the standard error for a query of length one by row."""
    length, right = scalars
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (queries @ rotation(dim).T).astype(np.float32)
    scale = (length / (right * np.sqrt(dim))).astype(np.float32)
    got = (turned @ signs.T) * scale + (queries @ centre).astype(np.float32)[:, None]
    error = length * np.sqrt(np.maximum(0, 1 - right**2)) / right / np.sqrt(max(1, dim - 1))
    return got, error.astype(np.float32)


def search_block(ids, vectors, codes, scalars, centre, query_ids, queries, k: int, factor: float):
    """(query place, row places, exact scores) of the best ``k`` rows of a block, ties to the smaller id."""
    dim = vectors.shape[1]
    scaled = vectors / _scale(vectors)
    scales = np.array([_scale(q) for q in queries]).reshape(-1, 1)
    small = queries / scales
    lengths = np.sqrt(np.einsum("ij,ij->i", small, small))
    longest = float(scalars[0].max(initial=0)) + float(np.linalg.norm(centre))
    order = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids, query_ids, side, sorter=order) for side in ("left", "right"))
    for a in range(0, len(queries), _SUB_ROWS):
        part, length = small[a : a + _SUB_ROWS], lengths[a : a + _SUB_ROWS, None]
        guess, error = estimate(codes, scalars, centre, dim, part)
        for i in range(len(part)):  # its own rows are no neighbours of a query
            guess[i, order[low[a + i] : high[a + i]]] = -np.inf
        rows = np.arange(len(part))[:, None]
        slack = 1e-5 * length * longest  # of single precision
        upper = guess + (factor * length * error + slack).astype(np.float32)
        near = np.isfinite(guess)
        if len(ids) > k:
            first = np.argpartition(-guess, k - 1, axis=1)[:, :k]
            known = np.where(np.isfinite(guess[rows, first]), np.einsum("ijd,id->ij", scaled[first], part), -np.inf)
            near &= upper >= known.min(axis=1)[:, None]
            near[rows, first] |= np.isfinite(guess[rows, first])  # a known score counts whatever its bound
        # The union of what the queries' bounds let through is multiplied at once; each query keeps its own.
        some = np.flatnonzero(near.any(axis=0))
        score = np.where(near[:, some], part @ scaled[some].T, -np.inf)
        last = np.partition(score, max(0, len(some) - k), axis=1)[:, max(0, len(some) - k)] if len(some) else np.zeros(len(part))
        for i in range(len(part)):
            mine = some[(score[i] >= last[i] - 1e-12 * length[i] * longest) & (score[i] > -np.inf)]
            exact = np.einsum("ij,j->i", vectors[mine], queries[a + i])
            best = np.lexsort((ids[mine], -exact))[:k]
            yield a + i, mine[best], exact[best]


class Best:
    """The best so far of every query of a pass, from the blocks of one task."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = [np.zeros(0, np.int64)] * queries
        self.scores = [np.zeros(0)] * queries

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[query], ids]), np.concatenate([self.scores[query], scores])
        keep = np.lexsort((ids, -scores))[: self.k]
        self.ids[query], self.scores[query] = ids[keep], scores[keep]


def nearest(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    block_bytes: int = BLOCK_BYTES,
    query_bytes: int = QUERY_BYTES,
    factor: float = ERROR_FACTOR,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row whose id is divisible by ``every``.

    Candidates are all rows of the query's dimension but those with its id; all of them come back
    if they are fewer than ``k``. Scores are double-precision inner products of the original
    vectors, ties go to the smaller id. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without an id, take no part. Repeated rows of one id and
    vector count once; of equal vectors only the ``k + 1`` smallest ids can be among the nearest
    and take part. Tables without usable rows give an empty result; other columns are ignored.
    """
    import pyarrow as pa

    v = F.col("v")
    given = rows.select(col(id_col).cast("bigint").alias("id"), col(vector_col).cast("array<double>").alias("v"))
    given = given.where(F.col("id").isNotNull() & finite(v) & nonzero(v)).distinct()
    alike = Window.partitionBy("v").orderBy("id")
    given = cut_lineage(given.withColumn("key", F.xxhash64("id", "v")).withColumn("dim", F.size("v")))
    kept = given.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).drop("n")
    asked = given.where(F.col("id") % every == 0)
    n, widest = kept.agg(F.count(F.lit(1)), F.max("dim")).first()
    spark = rows.sparkSession
    row_bytes = 8 * (widest or 1)
    most = max(1, block_bytes // row_bytes)  # rows of a block
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(-(-n // LEAST_BLOCK_ROWS), max(2 * cores, -(-n // (4 * most)))))
    passes = max(1, -(-asked.count() * row_bytes // query_bytes))

    def pack(batches):
        held: dict[int, list] = {}

        def block(dim):
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            for a in range(0, len(ids), most):
                own = vectors[a : a + most]
                cells = [ids[a : a + most], own, *encode(own)]
                arrays = [pa.array([dim], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]]
                yield pa.RecordBatch.from_arrays(arrays, "dim ids vectors codes scalars centre".split())

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for places, m in matrices(batch.column(1)):
                dim = m.shape[1]
                held.setdefault(dim, []).append((ids[places], m))
                if sum(len(x) for x, _ in held[dim]) >= most:
                    yield from block(dim)
        for dim in list(held):
            yield from block(dim)

    # The number of partitions is given: adaptive execution would put small blocks into one task.
    blocks = cut_lineage(kept.select("id", "v", "key").repartition(parts, "key").select("id", "v").mapInArrow(pack, _BLOCK))

    def one_pass(number: int) -> DataFrame:
        mine = asked.where(F.pmod("key", F.lit(passes)) == number) if passes > 1 else asked
        by_dim: dict[int, list] = {}
        for r in mine.select("id", "key", "dim", "v").toArrow().to_batches():  # at most query_bytes
            for places, m in matrices(r.column(3)):
                by_dim.setdefault(m.shape[1], []).append((r.column(0).to_numpy()[places], r.column(1).to_numpy()[places], m))
        shared = spark.sparkContext.broadcast({d: [np.concatenate(x) for x in zip(*p, strict=True)] for d, p in by_dim.items()})

        def search(batches):
            best: dict[int, Best] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    dim = row["dim"]
                    if dim not in shared.value:
                        continue
                    query_ids, _, queries = shared.value[dim]
                    read = lambda name, kind=np.float64: np.frombuffer(row[name], kind)  # noqa: B023, E731
                    ids = read("ids", np.int64)
                    codes, scalars = read("codes", np.uint8).reshape(len(ids), -1), read("scalars").reshape(2, -1)
                    own = best.setdefault(dim, Best(len(queries), k))
                    for i, places, scores in search_block(ids, read("vectors").reshape(-1, dim), codes, scalars, read("centre"), query_ids, queries, k, factor):
                        own.add(i, ids[places], scores)
            for dim, own in best.items():
                query_ids, query_keys, _ = shared.value[dim]
                for a in range(0, len(query_ids), 4096):
                    sizes = [len(x) for x in own.ids[a : a + 4096]]
                    each = [np.repeat(x[a : a + 4096], sizes) for x in (query_ids, query_keys)]
                    found = [np.concatenate(x[a : a + 4096]) for x in (own.ids, own.scores)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, each), *map(pa.array, found)], ["query_id", "query_key", "vec_id", "score"])

        return blocks.mapInArrow(search, _FOUND)

    found = one_pass(0)
    if passes > 1:
        found = cut_lineage(found)
        for number in range(1, passes):
            found = found.unionByName(cut_lineage(one_pass(number)))
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
