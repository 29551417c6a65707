"""Embedding whitening: leading components of the covariance by FEAST contour integration.

The corpus is reduced to a d x d covariance by Spark: vectors become integers, equal ones
one (a shuffle of packed vectors), sums and then centred products add up by task and
index. What reaches the driver has d * d entries, whatever the corpus.

1. Inertia counts (signs of the pivots of V - s, V made tridiagonal once) bracket the
   eigenvalues and cut the spectrum where it has gaps; the slices that hold the k largest
   are wanted.
2. A slice is projected by quadrature of (1 / 2 pi i) times the integral of (z - V)^-1 Y
   round a circle about it. Every (slice, node) is a Spark task: one complex shifted solve.
3. Rayleigh-Ritz in the projected subspace gives eigenpairs; they are the next Y until the
   residuals are at rounding.
4. A slice is done when as many Ritz values lie in it as inertia counts there, so none is
   missed; else it gets more nodes.

Every row is then projected on the components in its own task.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE = 256
#: Largest whole double within a long; larger entries are held at it.
LARGEST = float(2**63 - 1024)
#: Brackets of eigenvalues are this share of the norm wide; closer ones share a slice.
BRACKET = 2.0**-20
NODES, MOST_NODES, ROUNDS = 8, 128, 12
EXACT = decimal.Context(prec=60)


# vectors as integers ------------------------------------------------------------


def integers(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of longs) for each length of vector in a batch; rows that are null, empty or not all finite numbers are left out."""
    values, offsets = column.values, column.offsets.to_numpy()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry is NaN
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        vectors = flat[offsets[rows][:, None] + np.arange(d)]
        fine = np.isfinite(vectors).all(axis=1)
        if fine.any():
            with np.errstate(over="ignore"):
                yield rows[fine], np.clip(np.floor(SCALE * vectors[fine]), -LARGEST, LARGEST).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, 16 bits an entry where all of a row's fit, else 64."""
    small = (np.abs(x) < 2**15).all(axis=1)
    return [(r.astype("<i2") if s else r).tobytes() for r, s in zip(x, small, strict=True)]


def unpacked(column: pa.BinaryArray, d: int) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(b) == 2 * d for b in rows):
        return np.frombuffer(b"".join(rows), "<i2").reshape(-1, d).astype(np.int64)
    return np.array([np.frombuffer(b, "<i2" if len(b) == 2 * d else "<i8") for b in rows], np.int64).reshape(-1, d)


def fit_list(vectors: DataFrame) -> DataFrame:
    """(d, x): each distinct integer vector once. vectors: embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in integers(batch.column("embedding")):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(packed(x), pa.binary())], names=["d", "x"])

    return vectors.mapInArrow(run, "d int, x binary").distinct()


@dataclass
class Moments:
    """What is known of the fit list: n vectors with sums S by dimension."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they hold it, else Python's integers."""
        most = max([abs(s) for s in self.sums], default=0) + self.n * int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0
        if most < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviations(self, num: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) ** 2, exact."""
        if num.dtype == np.int64 and num.size and float(np.abs(num).max()) ** 2 * num.shape[1] < 2.0**62:
            return (num * num).sum(axis=1).tolist()
        return [sum(int(v) ** 2 for v in r) for r in num]


def moments(fit: DataFrame, d: int) -> Moments:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = unpacked(batch.column("x"), d)
            n += len(x)
            total = total + (x.sum(axis=0) if not x.size or np.abs(x).max() < 2**31 else x.astype(object).sum(axis=0))
        sums = pa.array([decimal.Decimal(int(v)) for v in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), sums], names=["i", "n", "s"])

    rows = fit.select("x").mapInArrow(run, "i long, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return Moments(rows[0].n, [int(r.s) for r in rows])


def summed_products(fit: DataFrame, d: int, known: Moments, width: int, of=None) -> np.ndarray:
    """Sum over the fit list of the outer products of its centred vectors, or of what `of` makes of them (width entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            c = (known.centred(unpacked(batch.column("x"), d)) / known.n).astype(np.float64)
            c = c if of is None else of(c)
            total += c.T @ c
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    found = fit.select("x").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    whole = np.zeros((width, width))
    whole[found.i, found.j] = found.v
    whole[found.j, found.i] = found.v
    return whole


# inertia ------------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix with the eigenvalues of v, by reflections."""
    a, d = v.copy(), len(v)
    for k in range(d - 2):
        u = a[k + 1 :, k].copy()
        length = np.linalg.norm(u)
        if length == 0:
            continue
        u[0] += length if u[0] >= 0 else -length
        u /= np.linalg.norm(u)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ u
        w = 2 * (w - (u @ w) * u)
        rest -= np.outer(u, w) + np.outer(w, u)
        a[k + 1 :, k] -= 2 * (u @ a[k + 1 :, k]) * u
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1) ** 2


def above(tri: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """For each shift, how many eigenvalues are larger: the positive pivots of the shifted matrix."""
    diag, off = tri
    least = max(np.finfo(float).tiny, float(off.max(initial=0.0)) * np.finfo(float).tiny / np.finfo(float).eps)
    count, pivot = np.zeros(len(shifts), np.int64), np.ones(len(shifts))
    for i in range(len(diag)):
        pivot = diag[i] - shifts - (off[i - 1] / pivot if i else 0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot > 0
    return count


def brackets(tri: tuple[np.ndarray, np.ndarray], norm: float) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) round each eigenvalue, falling, by bisection of the counts."""
    d = len(tri[0])
    low, high, at = np.full(d, -1.01 * norm), np.full(d, 1.01 * norm), np.arange(1, d + 1)
    while high[0] - low[0] > BRACKET * norm:
        mid = (low + high) / 2
        up = above(tri, mid) >= at
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return low, high


@dataclass
class Slice:
    """An interval of the spectrum, between gaps: eigenvalues first..last (from 0, falling) and the circle about them."""

    first: int
    last: int
    centre: float
    radius: float

    @property
    def count(self) -> int:
        return self.last - self.first + 1


def slices(low: np.ndarray, high: np.ndarray, k: int, norm: float) -> list[Slice]:
    """The slices that hold the k largest eigenvalues; what is closer than a few brackets stays together."""
    d, close = len(low), 8 * BRACKET * norm
    found, first = [], 0
    while first < k:
        last = first
        while last + 1 < d and low[last] - high[last + 1] < close:
            last += 1
        over = low[first - 1] - high[first] if first else norm
        under = low[last] - high[last + 1] if last + 1 < d else norm
        half = (high[first] - low[last]) / 2
        found.append(Slice(first, last, (high[first] + low[last]) / 2, half + min(over, under) / 2))
        first = last + 1
    return found


# contour integration ----------------------------------------------------------------


def projected(spark: SparkSession, v: np.ndarray, parts: dict[int, tuple[Slice, int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Each slice's subspace filtered by quadrature round its circle; a task for each (slice, node), of the upper half alone as V is real.

    parts: by number, the slice, its nodes and its subspace (d x m).
    """
    tasks = spark.createDataFrame([(p, j) for p, (_, nodes, _) in parts.items() for j in range(nodes)], "p int, j int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, j in zip(batch.column("p").to_pylist(), batch.column("j").to_pylist(), strict=True):
                at, nodes, y = parts[p]
                turn = np.exp(1j * np.pi * (2 * j + 1) / (2 * nodes))
                solved = np.linalg.solve((at.centre + at.radius * turn) * np.eye(len(v)) - v, y)
                share = (at.radius * turn * solved).real / nodes
                i, m = np.indices(share.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(share.size, p, np.int32)), pa.array(i.ravel()), pa.array(m.ravel()), pa.array(share.ravel())], names=["p", "i", "m", "v"])

    solved = tasks.repartition(len(parts) * NODES, "p", "j").mapInArrow(run, "p int, i long, m long, v double")
    rows = solved.groupBy("p", "i", "m").agg(F.sum("v").alias("v")).toPandas()
    out = {p: np.zeros(y.shape) for p, (_, _, y) in parts.items()}
    for p, own in rows.groupby("p"):
        out[p][own.i, own.m] = own.v
    return out


def leading(spark: SparkSession, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance, falling, and their unit vectors as columns; fewer if the rank is lower."""
    d, norm = len(v), float(np.abs(v).sum(axis=1).max(initial=0.0))
    if norm == 0 or not np.isfinite(norm):
        return np.empty(0), np.empty((d, 0))
    tri = tridiagonal(v)
    low, high = brackets(tri, norm)
    # eigenvalues that rounding alone makes are none
    k = min(k, int(above(tri, np.array([16 * d * np.finfo(float).eps * norm]))[0]))
    wanted = slices(low, high, k, norm)
    state = {}
    random = np.random.default_rng(12)
    for p, s in enumerate(wanted):
        state[p] = (s, NODES, random.standard_normal((d, min(d, s.count + max(2, s.count // 2)))))
    done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    best = dict.fromkeys(state, np.inf)
    while state:
        for _ in range(ROUNDS):
            for p, y in projected(spark, v, state).items():
                s, nodes, _ = state[p]
                q = np.linalg.qr(y)[0]
                q = np.linalg.qr(q)[0]
                ritz, small = np.linalg.eigh(q.T @ v @ q)
                vectors = q @ small
                inside = np.abs(ritz - s.centre) < s.radius
                values, own = ritz[inside][::-1], vectors[:, inside][:, ::-1]
                error = float(np.linalg.norm(v @ own - own * values, axis=0).max(initial=0.0)) / norm
                state[p] = (s, nodes, vectors)
                # as many as inertia counts, and residuals that are at rounding and don't fall any more
                if inside.sum() == s.count and error < 1e-13 and (error < 1e-15 or error > 0.25 * best[p]):
                    done[p] = (values, own)
                best[p] = error if inside.sum() == s.count else np.inf
            state = {p: x for p, x in state.items() if p not in done}
            if not state:
                break
        if any(nodes >= MOST_NODES for _, nodes, _ in state.values()):
            raise RuntimeError("a slice of the spectrum holds other eigenvalues than inertia counts there")
        state = {p: (s, 2 * nodes, y) for p, (s, nodes, y) in state.items()}
    if not done:
        return np.empty(0), np.empty((d, 0))
    values = np.concatenate([done[p][0] for p in sorted(done)])[:k]
    vectors = np.concatenate([done[p][1] for p in sorted(done)], axis=1)[:, :k]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


# rows -------------------------------------------------------------------------------

SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and each of the k leading components.

    Entries count in steps of 1/256; the components are those of the distinct vectors.
    Dropped: null vectors, empty ones, such with a null, NaN or infinite entry, and
    vectors of another length than most distinct ones have (the longer of two as frequent).
    Entries beyond a long are held at its range. Components without variance (rank below k)
    have no rows, so a table of equal vectors gives none, as does an empty one. Tied
    eigenvalues get some orthonormal vectors of their space. A null id stays, repeated
    rows have a row each. A deviation of over 38 digits is NULL. Other columns aren't
    looked at. The driver and each task hold d * d doubles.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    every = written(fit_list(rows.select("embedding")), "distinct-vectors")
    most = every.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], SCHEMA)
    d = most.d
    fit = every.filter(F.col("d") == d)
    known = moments(fit, d)
    covariance = summed_products(fit, d, known, d) / known.n
    values, components = leading(spark, covariance, k)
    if not len(values):
        return spark.createDataFrame([], SCHEMA)
    project = components / np.sqrt(values)
    explained = values / np.trace(covariance)
    identity = summed_products(fit, d, known, len(values), lambda c: c @ project) / known.n
    error, width = float(np.abs(identity - np.eye(len(values))).max()), len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in integers(batch.column("embedding")):
                if x.shape[1] != d:
                    continue
                num = known.centred(x)
                white = (num / known.n).astype(np.float64) @ project
                total = [None if v >= 10**38 else EXACT.create_decimal(v) for v in known.deviations(num)]
                m = len(x)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(np.repeat(at, width))), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)), pa.array(np.full(m * width, known.n)),
                    pa.array(total, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), width))), pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * width, error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
