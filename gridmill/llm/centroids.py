"""Centroid clustering in exact integers, with a float32 screen in front.

A vector's components become the integers floor(scale * x).  A task multiplies blocks of vectors by all centroids in float32 and turns
each product into an interval that surely holds |c|^2 - 2 x.c, which orders the centroids as the squared distance does:

    |fl(x.c) - x.c| <= g |x| |c|,   1 + g = (1 + u)^2 (1 + n u / (1 - n u)),   u = 2^-24,

for any order of summation, with or without fused steps; the squares cover the rounding of x and c to float32, and float64 steps get a margin of their own.
A centroid whose interval begins above the least upper end can't be nearest.  If one is left, it is nearest; those whose intervals overlap are
computed again in exact integers, and the smaller number wins a tie.  Integers of up to some 2^27 are summed in 64 bits, larger ones as Python's integers; beyond
some 2^60, where float32 products could overflow, every centroid counts as overlapping.

A round reads the vectors once.  A task hands on one exact sum for each centroid and component, in limbs of 40 bits that Spark adds up, so the driver
gets k * (n + 1) numbers, whatever the table's size, and k centroids of n integers travel with the tasks.  Nothing is grouped by a vector, so copies
make no hot key, and nothing depends on the order of rows.

Defined cases: null vectors and those with another number of components, nulls, NaN or infinities are left out.  A null id counts as the empty text in the
hash that chooses the first centroids, and stays null; rows with equal hashes are taken in order of their vectors.  Repeated rows each count.  With fewer vectors than
``k`` there are as many centroids; an empty table gives an empty result.  A distance or sum beyond 64 bits is null.  Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import floor, inf, isinf, isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import sliced, tidied, written

DIM, K, ROUNDS, SCALE = 64, 16, 3, 64
LIMB = 40
LONG = 1 << 63
#: Numbers of a block of vectors.
BLOCK = 1 << 17


def kept(vector: Column, dim: int) -> Column:
    """Has it ``dim`` components, all of them finite?"""
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def exact(x: float, scale: int) -> int:
    """floor(scale * x), the product taken as a double, and exactly where that overflows."""
    y = scale * x
    return floor(x) * scale if isinf(y) else floor(y)


def limits(dim: int) -> tuple[int, int]:
    """The largest integers whose squared distances 64 bits hold, and those whose products float32 holds, for ``dim`` components."""
    return isqrt((LONG - 1) // max(dim, 1)) // 2, isqrt((1 << 126) // max(dim, 1))


class Centroids:
    """Integer centroids and what screening needs of them."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.exact = np.array(rows, dtype=object)
        self.narrow, self.fitting = limits(len(rows[0]) if rows else 0)
        largest = np.array([max(map(abs, r), default=0) for r in rows], dtype=object)
        self.screened = largest <= self.fitting
        self.most = max(largest, default=0)
        low = np.array([r if s else [0] * len(r) for r, s in zip(rows, self.screened)], dtype=np.float64)
        self.low = low.astype(np.float32)
        self.square = np.array([sum(x * x for x in r) if s else 0 for r, s in zip(rows, self.screened)], dtype=np.float64)
        self.safe = np.array(rows, dtype=np.int64) if self.most <= self.narrow else None

    def intervals(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) bounds of |c|^2 - 2 z.c for each row and centroid; rows are integers that float32 products hold."""
        n, u = z.shape[1], 2.0**-24
        g = (1 + u) ** 2 * (1 + n * u / (1 - n * u)) - 1
        p = (z.astype(np.float32) @ self.low.T).astype(np.float64)
        middle = self.square - 2 * p
        norms = np.sqrt((z * z).sum(1))[:, None] * np.sqrt(self.square)
        e = (2 * g * norms + 2.0**-50 * (self.square + 2 * np.abs(p))) * (1 + 2.0**-40)
        low, high = middle - e, middle + e
        low[:, ~self.screened], high[:, ~self.screened] = -inf, inf
        return low, high

    def distances(self, z: np.ndarray, rows: np.ndarray, those: np.ndarray) -> np.ndarray:
        """Exact squared distances of some rows to one centroid each, as 64-bit or as Python's integers."""
        x = z[rows]
        if self.safe is not None and (not len(x) or np.abs(x).max() <= self.narrow):
            d = x.astype(np.int64) - self.safe[those]
            return np.einsum("ij,ij->i", d, d)
        d = _integers(x) - self.exact[those]
        return (d * d).sum(1)

    def nearest(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, exact squared distance, exact recomputations) of rows of integers."""
        short = np.ones((len(z), len(self.rows)), dtype=bool)
        fit = np.zeros(len(z), dtype=bool) if z.dtype == object else np.abs(z).max(1, initial=0) <= self.fitting
        low, high = self.intervals(z[fit].astype(np.float64))
        short[fit] = low <= high.min(1, keepdims=True)
        best = short.argmax(1)
        rows, those = np.nonzero(short & (short.sum(1) > 1)[:, None])
        if len(rows):
            d = self.distances(z, rows, those)
            # By row, then distance, then number: the first of each row wins.
            order = np.lexsort((those, d, rows)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda k: (rows[k], d[k], those[k])))
            first = order[np.diff(rows[order], prepend=-1) != 0]
            best[rows[first]] = those[first]
        return best, self.distances(z, np.arange(len(z)), best), len(rows)


def _integers(z: np.ndarray) -> np.ndarray:
    return z if z.dtype == object else np.array([[int(x) for x in row] for row in z], dtype=object).reshape(z.shape)


def _vectors(batches, dim: int, scale: int) -> Iterator[tuple]:
    """(ids, integers) of the kept rows, a block at a time: float64, which holds these integers, or objects where a product overflows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in sliced(batches, max(1, BLOCK // dim)):
        there = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False)
        batch = pa.RecordBatch.from_arrays(batch.columns, names=["id", "v"]).filter(there)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null is NaN here
        good = np.isfinite(x).all(1)
        ids, x = batch.column(0).filter(pa.array(good)), x[good]
        with np.errstate(over="ignore"):
            z = np.floor(x * scale)
        usual = np.isfinite(z).all(1)
        if len(ids):
            yield ids.filter(pa.array(usual)), z[usual]
            for k in np.flatnonzero(~usual):
                yield ids.slice(k, 1), np.array([[exact(v, scale) for v in x[k].tolist()]], dtype=object)


def _limbs(n: int) -> Iterator[tuple[int, int]]:
    """(limb, value): n is the sum of value * 2^(40 limb), and sums of limbs stay in 64 bits for eight million tasks."""
    k = 0
    while not -(1 << LIMB - 1) <= n < 1 << LIMB - 1:
        yield k, n & ((1 << LIMB) - 1)
        n >>= LIMB
        k += 1
    yield k, n


def _sums(vectors: DataFrame, centroids: Centroids, dim: int, scale: int) -> dict[int, list[int]]:
    """The exact componentwise sums and, last, the number of the vectors nearest to each centroid that has any."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((len(centroids.rows), dim + 1), dtype=object)
        for ids, z in _vectors(batches, dim, scale):
            best, _, _ = centroids.nearest(z)
            narrow = z.dtype != object and (not z.size or np.abs(z).max() <= centroids.narrow)
            whole = z.astype(np.int64) if narrow else _integers(z)
            for c in np.unique(best):
                some = whole[best == c]
                total[c, :dim] += some.sum(0).astype(object)
                total[c, dim] += len(some)
        rows = [(c, i, k, v) for c in range(len(total)) if total[c, dim] for i in range(dim + 1) for k, v in _limbs(int(total[c, i]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "i", "limb", "v"])

    parts = vectors.mapInArrow(tidied(run), "cluster int, i int, limb int, v long").groupBy("cluster", "i", "limb").agg(F.sum("v").alias("v"))
    found: dict[int, list[int]] = {}
    for c, i, limb, v in parts.collect():  # k * (dim + 1) numbers, a few limbs each
        found.setdefault(c, [0] * (dim + 1))[i] += v << (LIMB * limb)
    return found


def first_centroids(vectors: DataFrame, k: int, dim: int, scale: int) -> list[list[int]]:
    """The ``k`` kept vectors with the smallest sha256 of ``1:<id>``, in that order."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.where(kept(F.col("v"), dim)).select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return [[exact(x, scale) for x in r.v] for r in rows]


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(assigned, centroids): id, cluster and squared distance of every kept vector after ``rounds`` updates, and the centroids they were assigned to."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    centroids = first_centroids(rows, k, dim, scale)
    for _ in range(rounds if centroids else 0):
        for c, total in _sums(rows, Centroids(centroids), dim, scale).items():
            centroids[c] = [x // total[dim] for x in total[:dim]]
    last = Centroids(centroids)

    def run(batches):
        import pyarrow as pa

        for ids, z in _vectors(batches, dim, scale) if centroids else ():
            best, d, _ = last.nearest(z)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array([x if x < LONG else None for x in d.tolist()], pa.int64())], names=["id", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidied(run), f"id {kind}, cluster int, distance long"), centroids


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """One row for each kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    assigned, centroids = clustered(vectors, id_col, vector_col, k, rounds, dim, scale)
    assigned = written(assigned)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("beyond"))
    own = {c: None if beyond else int(s) for c, s, beyond in sums.collect()}  # k rows
    inertia = reduce(lambda a, b: None if a is None or b is None else a + b, own.values(), 0)
    long = lambda x: x if x is not None and x < LONG else None
    told = [(c, long(s), long(inertia), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in own.items()]
    by = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(by), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
