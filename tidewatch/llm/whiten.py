"""Embedding whitening: the covariance by polarisation, from exact squares of centred sums of dimensions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Context, Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import share, table

COMPONENTS = 32
MOST_DIMENSIONS = 4096  # the covariance, so many squared, is on the driver
SAFE = 2**62
_TOTAL = "dim int, i int, j int, total decimal(38,0)"


def integers(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000, embedding: str = "embedding") -> DataFrame:
    """vec_id and x = floor(scale * c) + shift of each entry c; vectors that are null or hold null or non-finite entries go."""
    fine = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    wide = F.raise_error(F.lit("an entry does not fit a 64-bit integer"))
    whole = lambda c: F.when(F.abs(c.cast("double") * scale) < float(2**61), F.floor(c.cast("double") * scale).cast("long") + shift).otherwise(wide)
    return vectors.where(F.col(embedding).isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(embedding, whole).alias("x"))


def _matrices(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The vectors of a batch, a matrix for each length; empty vectors have no dimensions to add."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        if dim:
            own = column if (sizes == dim).all() else column.filter(pa.array(sizes == dim))
            yield own.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, in 64-bit integers where twice that fits, else in Python's."""
    largest = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    return x * n - sums.astype(np.int64) if largest * 2 < SAFE else x.astype(object) * n - sums


def _squares(z: np.ndarray) -> list[int]:
    """Exact sums of the squares of each column."""
    if z.dtype == object:
        return [int(v) for v in (z * z).sum(axis=0)]
    most = int(np.abs(z).max(initial=0))
    if most * most * len(z) < SAFE:
        return [int(v) for v in np.einsum("ij,ij->j", z, z)]
    low = z & 0xFFFFFF  # z = high * 2^24 + low; each of the three sums fits where high does
    high = z >> 24
    if int(np.abs(high).max()) ** 2 * len(z) >= SAFE or 2**48 * len(z) >= SAFE or (most >> 24) * 2**24 * len(z) >= SAFE:
        return [sum(v * v for v in c) for c in z.T.tolist()]
    parts = [np.einsum("ij,ij->j", a, b) for a, b in ((high, high), (high, low), (low, low))]
    return [(int(a) << 48) + (int(b) << 25) + int(c) for a, b, c in zip(*parts)]


def _sums(x: np.ndarray) -> list[int]:
    """Exact sums of each column."""
    return [int(v) for v in (x if int(np.abs(x).max(initial=0)) * len(x) < SAFE else x.astype(object)).sum(axis=0)]


def _totals(vectors: DataFrame, add: Callable) -> DataFrame:
    """Sums over all vectors of what add(matrix) gives as ((i, j) -> integer); a task adds up its own first."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            for x in _matrices(batch.column(0)):
                own = held.setdefault(x.shape[1], {})
                for at, v in add(x).items():
                    own[at] = own.get(at, 0) + v
        for dim, own in held.items():
            ij = np.array(list(own), np.int32).reshape(-1, 2)
            total = pa.array([*map(_decimal, own.values())], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ij), dim, np.int32)), pa.array(ij[:, 0]), pa.array(ij[:, 1]), total], names=["dim", "i", "j", "total"])

    return vectors.select("x").mapInArrow(run, _TOTAL).groupBy("dim", "i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total"))


def _decimal(v: int):
    if abs(v) >= 10**38:
        raise OverflowError("an exact sum has more than 38 digits")
    return Context(prec=40).create_decimal(Decimal(v))


class Fit:
    """The fit of the vectors of one length: n, sums, eigenvalues (falling), unit eigenvectors (columns), trace, rank.

    squares: (i, j) -> the exact sum of (n x_i - S_i)^2 for i = j, and of (n (x_i + x_j) - S_i - S_j)^2 else. A
    covariance is half of what the square of the sum has over the squares of both, so every entry is the nearest double
    of an exact fraction. A component counts as without variance where its eigenvalue is below what rounding leaves.
    """

    def __init__(self, dim: int, n: int, sums: dict, squares: dict):
        self.dim, self.n, self.sums = dim, n, [sums[i] for i in range(dim)]
        v = np.empty((dim, dim))
        for (i, j), q in squares.items():
            own = q if i == j else Fraction(q - squares[i, i] - squares[j, j], 2)
            v[i, j] = v[j, i] = float(Fraction(own) / n**3)
        self.covariance = v
        values, vectors = np.linalg.eigh(v)
        self.values, self.vectors = values[::-1].copy(), vectors[:, ::-1].copy()
        self.trace = float(Fraction(sum(squares[i, i] for i in range(dim)), n**3))
        self.rank = int((self.values > max(self.trace, 0.0) * dim * 2**-52).sum())

    def kept(self, components: int) -> int:
        return min(components, self.dim)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _exact(x, self.n, np.array(self.sums, object))

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        """(x - S/n) on each component, over the root of its eigenvalue; nan where the component has no variance."""
        k = min(self.kept(components), self.rank)
        z = (self.centred(x) / self.n).astype(np.float64) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))
        return np.concatenate([z, np.full((len(x), self.kept(components) - k), np.nan)], axis=1)


def fit(vectors: DataFrame) -> dict[int, Fit]:
    """A Fit for each length of x. Three passes of sums; the driver gets one integer for each pair of dimensions."""
    plain = _totals(vectors, lambda x: {(-1, -1): len(x)} | {(i, -1): v for i, v in enumerate(_sums(x))})
    got: dict = {}
    for r in plain.toLocalIterator():
        if r["dim"] > MOST_DIMENSIONS:
            raise ValueError(f"vectors of over {MOST_DIMENSIONS} dimensions")
        got.setdefault(r["dim"], {})[r["i"]] = int(r["total"])
    held = share(vectors.sparkSession, {d: (s[-1], [s[i] for i in range(d)]) for d, s in got.items()})
    known: dict = {}

    def squares(x: np.ndarray) -> dict:
        dim = x.shape[1]
        n, sums = known.setdefault(dim, None) or held()[dim]
        known[dim] = n, sums
        y = _exact(x, n, np.array(sums, object))
        out = dict(zip(((i, i) for i in range(dim)), _squares(y)))
        for i in range(dim - 1):  # all pairs of i with later dimensions at once
            out.update(zip(((i, j) for j in range(i + 1, dim)), _squares(y[:, i + 1 :] + y[:, i : i + 1])))
        return out

    every: dict = {}
    for r in _totals(vectors, squares).toLocalIterator():
        every.setdefault(r["dim"], {})[r["i"], r["j"]] = int(r["total"])
    return {d: Fit(d, got[d][-1], got[d], q) for d, q in every.items()}


def identity_error(vectors: DataFrame, fits: dict[int, Fit], components: int = COMPONENTS) -> dict[int, float | None]:
    """By length: the largest absolute entry of the covariance of the whitened vectors, as they come out, minus the identity.

    Whitened values are centred by the exact mean, so their own mean is rounding only. Components without variance do not
    count; without any the error is None.
    """
    held = share(vectors.sparkSession, fits)

    def run(batches):
        fits, sums = held(), {}
        for batch in batches:
            for x in _matrices(batch.column(0)):
                own = fits[x.shape[1]]
                z = own.whiten(x, components)[:, : min(own.kept(components), own.rank)]
                sums[own.dim] = sums.get(own.dim, 0) + z.T @ z
        for dim, s in sums.items():
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], names=["dim", "i", "j", "total"])

    total = vectors.select("x").mapInArrow(run, "dim int, i int, j int, total double").groupBy("dim", "i", "j").agg(F.sum("total").alias("total"))
    out: dict = {d: None for d in fits}
    for r in total.toLocalIterator():
        out[r["dim"]] = max(out[r["dim"]] or 0.0, abs(r["total"] / fits[r["dim"]].n - (r["i"] == r["j"])))
    return out


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null or hold null or non-finite entries take no part; an entry that does not fit 64 bits is an
    error. Vectors of one length are one fit list; lengths do not mix. Rows that repeat a vec_id, or have none, are rows
    of their own. An empty table gives no rows, and so do empty vectors, which have no component. A component without
    variance (a constant dimension, fewer rows than dimensions) has a null whitened value; if none has any, explained
    and identity_error are null. Other columns are ignored.

    Tasks add up exact integers for each dimension and pair, so the shuffle has one row for a task and pair, whatever the
    number of vectors, and no key is hot. The driver holds the covariance: at most MOST_DIMENSIONS squared entries.
    """
    rows = integers(vectors, scale, shift)
    fits = fit(rows)
    errors = identity_error(rows, fits, components)
    held = share(rows.sparkSession, (fits, errors))

    @F.pandas_udf("n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fits, errors = held()
        for xs in batches:
            sizes, rows = xs.map(len).to_numpy(), np.empty(len(xs), object)
            for dim in np.unique(sizes):
                own, at = fits[dim], np.flatnonzero(sizes == dim)
                x = np.stack(xs.to_numpy()[at]).astype(np.int64)
                share_of = [float(v) / own.trace if own.trace > 0 else None for v in own.values[: own.kept(components)]]
                for i, d, w in zip(at, _squares(own.centred(x).T), own.whiten(x, components).tolist()):
                    rows[i] = (own.n, _decimal(d), [None if math.isnan(v) else v for v in w], share_of, errors[dim])
            yield pd.DataFrame(rows.tolist(), columns=["n", "deviation", "whitened", "explained", "identity_error"])

    done = rows.where("size(x) > 0").select("vec_id", apply("x").alias("r")).select("vec_id", "r.*")
    done = done.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "v"))
    return done.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "v.whitened", "v.explained", "identity_error")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
