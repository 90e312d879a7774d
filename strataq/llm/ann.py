"""Nearest neighbours by randomly rotated one-bit codes.

A vector is normalised and rotated by one seeded random orthogonal matrix; the signs of the result are its
code. With o the rotated unit vector, c its code scaled to unit length, and <o, c> kept as correction scalar,
<c, q> / <o, c> estimates the inner product with a rotated unit query q without bias, and the error stays within
``epsilon * sqrt((1 - <o, c>^2) / (d - 1)) / <o, c>`` but for a chance that falls off as exp(-epsilon^2 / 2).

Vectors are coded once, where they are read, and dealt into groups with their codes. The stated queries meet the groups in
a grid: a task holds one group of queries and streams one group of vectors past them, so the copies of either
side follow from what a task may hold. For a chunk of vectors the codes give every query an estimate and an upper bound; the best
estimates are reranked by the exact cosine of the original vectors, and then all whose upper bound reaches the k-th best
exact cosine so far. Each task hands on k neighbours a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.llm.common import by_key, small_batches

#: Vectors of a chunk, and queries that meet them at once.
CHUNK, QUERIES = 4096, 256


def rotation(d: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def tame(x: np.ndarray) -> np.ndarray:
    """Rows of extreme size divided by a power of two, which leaves their direction as it is to the bit."""
    e = np.frexp(np.abs(x).max(1))[1]
    return np.ldexp(x, -np.where(np.abs(e) > 100, e, 0)[:, None])


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sign bits packed in 64-bit words, correction scalar <o, c>) of the rows of ``x``."""
    o = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn
    return pack(o > 0), np.abs(o).sum(1) / np.sqrt(x.shape[1])


def pack(bits: np.ndarray) -> np.ndarray:
    b = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(b, ((0, 0), (0, -b.shape[1] % 8))).view(np.uint64)


def bounds(codes: np.ndarray, scale: np.ndarray, q: np.ndarray, turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of each query with each coded vector, and their error bounds.

    The rotated query is cut to steps of 8 bits; its product with a sign code is a sum of popcounts
    of the code with the query's eight bit planes.
    """
    d = q.shape[1]
    r = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ turn
    low = r.min(1, keepdims=True)
    step = np.maximum((r.max(1, keepdims=True) - low) / 255, 1e-300)
    whole = np.rint((r - low) / step).astype(np.int64)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    dot = np.zeros((len(q), len(codes)), np.int64)
    for p in range(8):
        plane = pack(whole >> p & 1 > 0)
        dot += np.bitwise_count(codes[None, :, :] & plane[:, None, :]).sum(2, dtype=np.int64) << p
    signed = 2 * (low * ones + step * dot) - r.sum(1, keepdims=True)
    error = epsilon * np.sqrt(np.maximum(0, 1 - scale**2) / max(1, d - 1)) / scale
    return signed / np.sqrt(d) / scale, error + step * ones / np.sqrt(d) / scale + 1e-9


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact cosine of rows of ``a`` with ``b`` in double precision, summed from the first component to the last."""
    total = lambda x: np.cumsum(x, axis=-1)[..., -1]
    return total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector that is neither null, zero, nor holds a null, NaN or infinity."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    )


def coded(base: DataFrame, seed: int) -> DataFrame:
    """(vec_id, dim, vec, code, scale) of each usable vector; vec and code packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            lists = b.column(1).to_pylist()
            dims = np.array([len(v) for v in lists])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = tame(np.array([lists[k] for k in at.tolist()], np.float64))
                codes, scale = encode(x, turns.setdefault(dim, rotation(dim, seed)))
                cols = [b.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array([r.tobytes() for r in x]), pa.array([c.tobytes() for c in codes]), pa.array(scale)]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "dim", "vec", "code", "scale"])

    return base.mapInArrow(run, "vec_id long, dim int, vec binary, code binary, scale double")


class Best:
    """The k nearest so far of the queries of one dimension."""

    def __init__(self, ids: list[int], vecs: list[bytes], dim: int, k: int, epsilon: float, seed: int) -> None:
        self.ids, self.q = np.array(ids, np.int64), np.frombuffer(b"".join(vecs), "<f8").reshape(-1, dim)
        self.turn, self.k, self.epsilon = rotation(dim, seed), k, epsilon
        self.near = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.score = np.full((len(ids), k), -np.inf)

    def meet(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> None:
        for lo in range(0, len(self.ids), QUERIES):
            q, own = self.q[lo : lo + QUERIES], ids[None, :] == self.ids[lo : lo + QUERIES, None]
            estimate, error = bounds(codes, scale, q, self.turn, self.epsilon)
            estimate[own] = -np.inf
            m = min(self.k, len(ids))
            top = np.argpartition(estimate, -m, axis=1)[:, -m:]
            for n in range(len(q)):
                near, score = self.near[lo + n], self.score[lo + n]
                floor = max(score[-1], cosine(x[top[n]], q[n])[~own[n, top[n]]].min(initial=np.inf) if m == self.k and not own[n, top[n]].any() else -np.inf)
                at = np.flatnonzero((estimate[n] + error[n] >= floor) & ~own[n])
                all_ids, all_scores = np.concatenate((near, ids[at])), np.concatenate((score, cosine(x[at], q[n])))
                best = np.lexsort((all_ids, -all_scores))[: self.k]
                self.near[lo + n], self.score[lo + n] = all_ids[best], all_scores[best]

    def found(self) -> pa.RecordBatch:
        some = self.score > -np.inf
        cols = (np.repeat(self.ids, self.k).reshape(some.shape)[some], self.near[some], self.score[some])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])


def _meet(k: int, epsilon: float, seed: int):
    """Rows (cell, dim, asked, vec_id, vec, code, scale) in order, a cell's queries before its vectors, to (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best, ids, vecs, chunk = None, None, [], [], []

        def meet():
            if chunk and (best or ids):
                i, v, c, s = zip(*chunk)
                x = np.frombuffer(b"".join(v), "<f8").reshape(len(i), -1)
                found = best or Best(ids, vecs, x.shape[1], k, epsilon, seed)
                found.meet(np.array(i, np.int64), x, np.frombuffer(b"".join(c), np.uint64).reshape(len(i), -1), np.array(s))
                return found
            return best

        for b in batches:
            for g, d, asked, i, v, c, s in zip(*(col.to_pylist() for col in b.columns)):
                if (g, d) != cell:
                    best = meet()
                    if best:
                        yield best.found()
                    cell, best, ids, vecs, chunk = (g, d), None, [], [], []
                if asked:
                    ids.append(i)
                    vecs.append(v)
                else:
                    chunk.append((i, v, c, s))
                    if len(chunk) == CHUNK:
                        best, chunk = meet(), []
        best = meet()
        if best:
            yield best.found()

    return run


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, epsilon: float = 3.0, seed: int = 0, vectors_a_group: int = 1 << 24, queries_a_group: int = 1 << 18, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of all other vectors by exact cosine, ties to the smaller vec_id.

    Rows whose vector is null, empty, zero or holds null or non-finite components take no part, nor do rows
    without an id; vectors of another length than a query's are no candidates for it. A candidate with the query's own id is left
    out. Repeated rows are candidates as often as they occur; a query row that occurs again is one query, and different vectors under
    one query id have their lists merged into one. An empty table gives none.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    base, ask = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col).distinct()
    # A cell of the grid takes no more queries than a task may hold; beyond that there are enough cells for all cores.
    h = max(1, -(-ask.count() // queries_a_group))
    n = base.count()
    g = max(1, -(-n // vectors_a_group), min(-(-n // CHUNK), 4 * spark.sparkContext.defaultParallelism))
    number = lambda n: F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = [
        coded(ask, seed).withColumn("y", number(h)).withColumn("x", every(g)).withColumn("asked", F.lit(True)),
        coded(base, seed).withColumn("x", number(g)).withColumn("y", every(h)).withColumn("asked", F.lit(False)),
    ]
    cells = sides[0].unionByName(sides[1]).select((F.col("x") * h + F.col("y")).alias("cell"), "dim", "asked", "vec_id", "vec", "code", "scale")
    ordered = by_key(cells, "cell").sortWithinPartitions("cell", "dim", F.desc("asked"), "vec_id")
    found = ordered.mapInArrow(_meet(k, epsilon, seed), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
