"""Embedding whitening: two passes of covariance, eigenvectors by LAPACK, a broadcast projection.

Entries become whole numbers x. The first pass sums the distinct vectors exactly (whole numbers of any size), the second
sums the outer products of the centred vectors by matrix products of blocks; both merge by treeAggregate, one partial of a
task at a time. A row is centred as (n x - S) / n with whole numbers, so that the mean costs no digits. What the driver
holds is one matrix of the dimensions; what is broadcast is the mean and one vector a component.

Vectors that are null or hold null or non-finite entries take no part, nor do rows whose entries don't fit: |64 c| is
limited to 2^52, values beyond it stop there. Entries that a shorter vector lacks count as 0. Components without variance
(constant tables, fewer distinct vectors than dimensions) have no whitened value and are left out; an empty table, or one
of equal vectors, gives no rows. A repeated row is answered each time and counts once in the fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows of a matrix product.
BLOCK = 4096
_BOUND = 2**52
_LONG = 2**63 - 1
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the vectors that take part, as whole numbers."""
    entry = F.col("embedding")
    good = entry.isNotNull() & ~F.coalesce(F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    whole = lambda c: F.floor(F.greatest(F.lit(-float(_BOUND)), F.least(F.lit(float(_BOUND)), c.cast("double") * SCALE))).cast("long") + SHIFT
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entry, whole).alias("x"))


def _blocks(batches, column: str, dims: int):
    """(batch, rows): the vectors of each batch as a matrix of whole numbers, BLOCK rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            lists = part.column(column)
            lens = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy().astype(np.int64)
            if (lens == dims).all():
                yield part, flat.reshape(-1, dims)
            else:
                m = np.full((len(lens), dims), SHIFT, np.int64)
                at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
                m[np.repeat(np.arange(len(lens)), lens), at] = flat
                yield part, m


def _merged(partials: DataFrame, add, zero):
    """treeAggregate of what the tasks wrote, one value each."""
    return partials.rdd.map(lambda r: r[0]).treeAggregate(zero, add, add)


def exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and the sum of each dimension, as whole numbers without limit."""

    def run(batches):
        n, total = 0, np.zeros(dims, object)
        for _, m in _blocks(batches, "x", dims):
            n += len(m)
            total = total + m.sum(axis=0).astype(object)  # BLOCK numbers below 2^53 fit a long
        yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, [n, *total]))])], names=["sums"])

    def add(a, b):
        if not a or not b:
            return a or b
        return ",".join(str(int(x) + int(y)) for x, y in zip(a.split(","), b.split(",")))

    sums = [int(x) for x in _merged(fit.select("x").mapInArrow(run, "sums string"), add, "").split(",") if x] or [0] * (dims + 1)
    return sums[0], sums[1:]


class Centre:
    """Centres rows of whole numbers on S / n: numerators n x - S exactly, deviations as doubles."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.base = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s - n * (s // n) for s in sums], object)  # 0 <= rest < n

    def deviations(self, m: np.ndarray) -> np.ndarray:
        return (m - self.base) - (self.rest / self.n).astype(np.float64)

    def squares(self, m: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2 of each row, exact; beyond a long it stops at the largest."""
        far = m - self.base
        bound = (int(np.abs(far).max(initial=0)) + 1) * self.n
        kind = np.int64 if bound * bound * max(1, m.shape[1]) < 2**63 else object
        numerators = far.astype(kind) * self.n - self.rest.astype(kind)
        return [min(_LONG, int(x)) for x in (numerators * numerators).sum(axis=1)]


def _products(fit: DataFrame, dims: int, width: int, of) -> np.ndarray:
    """The sum over all rows of the outer products of of(rows), a matrix of `width` columns a block."""

    def run(batches):
        total = np.zeros((width, width))
        for _, m in _blocks(batches, "x", dims):
            z = of(m)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["products"])

    def add(a, b):
        if not a or not b:
            return a or b
        return (np.frombuffer(a) + np.frombuffer(b)).tobytes()

    total = _merged(fit.select("x").mapInArrow(run, "products binary"), lambda a, b: add(bytes(a), bytes(b)), b"")
    return np.frombuffer(total or np.zeros(width * width).tobytes()).reshape(width, width)


class Whitening:
    """The fit: n, exact sums, eigenvalues (falling), unit eigenvectors as columns, their share of the trace, and the
    largest entry by which the covariance of the whitened fit list misses the identity."""

    def __init__(self, fit: DataFrame, components: int = COMPONENTS):
        self.dims = fit.agg(F.max(F.size("x"))).first()[0] or 0
        self.n, self.sums = exact_sums(fit, self.dims) if self.dims else (0, [])
        self.values, self.share, self.error = np.zeros(0), np.zeros(0), 0.0
        if not self.n:
            return
        self.centre = centre = Centre(self.n, self.sums)
        cov = _products(fit, self.dims, self.dims, centre.deviations) / self.n
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > max(values[-1], 0) * self.dims * np.finfo(float).eps * 8]
        if not len(order):
            return
        vectors = vectors[:, order]
        top = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.sign(vectors[top, np.arange(len(order))])  # one sign for reruns
        self.values, self.share = values[order], values[order] / np.trace(cov)
        self.projection = projection = vectors / np.sqrt(self.values)
        white = _products(fit, self.dims, len(order), lambda m: centre.deviations(m) @ projection) / self.n
        self.error = float(np.abs(white - np.eye(len(order))).max())

    def transform(self, x: DataFrame) -> DataFrame:
        """A row for each row of x (vec_id, x) and component."""
        k = len(self.values)
        if not k:
            return x.sparkSession.createDataFrame([], OUT)
        held = x.sparkSession.sparkContext.broadcast((self.centre, self.projection))
        dims, n, share, error = self.dims, self.n, self.share, self.error

        def run(batches):
            centre, projection = held.value
            for part, m in _blocks(batches, "x", dims):
                rows = len(m)
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)), pa.array(np.repeat(np.array(centre.squares(m), np.int64), k)), pa.array((centre.deviations(m) @ projection).ravel()), pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return x.mapInArrow(run, OUT)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors (vec_id, embedding) whitened: vec_id, component, n, deviation, whitened, explained, identity_error. The
    fit list is every distinct vector once; copies meet by value after each task has kept one of its own."""
    x = quantised(vectors)
    fit = written(x.select("x").distinct(), "fit")
    return Whitening(fit, components).transform(x)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
