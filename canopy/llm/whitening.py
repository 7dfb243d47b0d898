"""Whitening of embeddings, fitted with the multiplicity of equal vectors.

A vector's entries become whole numbers x = floor(64 c) + 1000000.  Identical x are grouped into one row with the number of their copies, which
is its weight: counts and sums are weighted sums of whole numbers, so exact, and the covariance is a weighted centred matrix product,
made by task and summed by entry.  Its eigenvectors are found on the driver, from a matrix as wide as a vector whatever the number of rows.
Each distinct vector is whitened once, and rows get their vector's result by a join on a 128-bit key of x.

With `multiplicity=False` every distinct vector weighs one, so that copies don't pull the fit; then n, sums and the covariance are of distinct vectors.

Odd rows.  A vector that is null or empty, that holds a null or a value that isn't finite, or whose entries leave the whole
numbers that a double holds exactly, is dropped; so is one whose length isn't that of most (the longer of equals), as only equal
lengths have a covariance.  A null id stays null, repeated ids and rows are answered each.  Components whose variance is 0 (up to 1e-12 of the largest, as
with fewer vectors than entries, or copies of one) can't be whitened and have no rows; with none left, or no vectors, the result is empty.
A deviation beyond a long is null.  Other columns are not in the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import staged

STEP, OFFSET, EXACT = 64, 1_000_000, 2.0**53


@dataclass(frozen=True)
class WhiteningParams:
    components: int = 32
    #: Whether a vector counts as often as it occurs in the fit.
    multiplicity: bool = True
    #: Entries that a task multiplies at once.
    tile: int = 1_000_000


@dataclass(frozen=True)
class Whitening:
    """A fit: n vectors with sums S, kept as S = n * base + rest, and scaled components as columns."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None where a long can't hold one."""
        off = x - self.base
        if self.n * (int(np.abs(off).max(initial=0)) + 1) < 2**63:
            off = self.n * off - self.rest
            if x.shape[1] * int(np.abs(off).max(initial=0)) ** 2 < 2**63:
                return (off * off).sum(axis=1).tolist()
        rest = [int(r) for r in self.rest]
        sums = [sum((self.n * a - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in (x - self.base).tolist()]
        return [s if s < 2**63 else None for s in sums]


def whole(vector: str | Column) -> Column:
    """Entries of an embedding as whole numbers."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEP) + OFFSET)


def usable(vector: str) -> Column:
    inside = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * STEP < EXACT - OFFSET)
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, inside)


def _usual_length(rows: DataFrame) -> int:
    """The length that most vectors have; counts by length are summed in Spark, only the largest comes."""
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"k1": F.xxhash64(F.lit(1), "x"), "k2": F.xxhash64(F.lit(2), "x")})


def _vectors(batches: Iterator[pa.RecordBatch], dim: int, tile: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches of bounded size, with the vectors of their column `x`."""
    step = max(1, tile // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, np.asarray(part.column("x").flatten()).reshape(-1, dim)


def _summed(rows: DataFrame, dim: int, tile: int) -> tuple[int, list[int]]:
    """Weighted number and sums of vectors, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1, np.int64)
        for part, x in _vectors(batches, dim, tile):
            weight = np.asarray(part.column("weight"))
            total[0] += weight.sum()
            total[1:] += ((x - OFFSET) * weight[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(dim + 1, dtype=np.int32), "v": total})

    # One row an entry of a vector.
    told = dict(rows.select("x", "weight").mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v")).collect())
    n = told.get(0, 0)
    return n, [told.get(i + 1, 0) + n * OFFSET for i in range(dim)]


def _covariance(rows: DataFrame, n: int, dim: int, wide: int, tile: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weighted mean of products of centred vectors: each task multiplies its own, entries are summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for part, x in _vectors(batches, wide, tile):
            c = centred(x)
            total += (c * np.asarray(part.column("weight"), float)[:, None]).T @ c
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    out = np.zeros((dim, dim))
    # As many rows as the matrix has entries on one side of its diagonal.
    for i, j, v in rows.select("x", "weight").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v / n
    return out


def fit(distinct: DataFrame, dim: int, p: WhiteningParams) -> Whitening | None:
    """Fits rows of (x, weight); None if there is nothing to whiten."""
    n, sums = _summed(distinct, dim, p.tile)
    if not n:
        return None
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s - n * int(b) for s, b in zip(sums, base, strict=True)], np.int64)
    plain = Whitening(n, base, rest, np.zeros((dim, 0)), np.zeros(0))
    variance, vectors = np.linalg.eigh(_covariance(distinct, n, dim, dim, p.tile, plain.centred))
    variance, vectors = variance[::-1], vectors[:, ::-1]
    k = min(p.components, int((variance > max(0.0, 1e-12 * float(variance[0]))).sum()))
    return Whitening(n, base, rest, vectors[:, :k] / np.sqrt(variance[:k]), variance[:k] / np.maximum(variance, 0).sum()) if k else None


def _whitened(distinct: DataFrame, w: Whitening, p: WhiteningParams) -> DataFrame:
    dim, k = w.components.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _vectors(batches, dim, p.tile):
            out = w.centred(x) @ w.components
            values = pa.ListArray.from_arrays(np.arange(0, out.size + 1, k, dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), part.column("weight"), pa.array(w.deviation(x), pa.int64()), values], names=["k1", "k2", "weight", "deviation", "whitened"])

    return staged(distinct.mapInArrow(run, "k1 long, k2 long, weight long, deviation long, whitened array<double>"))


def _identity_error(whitened: DataFrame, w: Whitening, p: WhiteningParams) -> float:
    """Largest entry of the whitened vectors' covariance less the identity."""
    k, n = w.components.shape[1], w.n
    mean = [0.0] * k
    terms = whitened.select(F.posexplode("whitened").alias("i", "z"), "weight").groupBy("i").agg(F.sum(F.col("z") * F.col("weight")))
    for i, v in terms.collect():  # one row a component
        mean[i] = v / n
    centre = np.array(mean)
    found = _covariance(whitened.select(F.col("whitened").alias("x"), "weight"), n, k, k, p.tile, lambda z: z - centre)
    return float(np.abs(found - np.eye(k)).max())


def whiten(vectors: DataFrame, p: WhiteningParams | None = None) -> DataFrame:
    """vec_id, deviation, whitened (array), and the fit's n, explained (array) and identity_error, for each usable row of (vec_id, embedding)."""
    p = p or WhiteningParams()
    rows = vectors.where(usable("embedding")).select("vec_id", whole("embedding").alias("x"))
    dim = _usual_length(rows)
    rows = rows.where(F.size("x") == dim)
    weight = F.count("*") if p.multiplicity else F.lit(1).cast("long")
    distinct = staged(_keyed(rows.groupBy("x").agg(weight.alias("weight"))))
    fitted = fit(distinct, dim, p) if dim else None
    if fitted is None:
        return rows.select("vec_id", F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("explained"), F.lit(None).cast("double").alias("identity_error"))
    made = _whitened(distinct, fitted, p)
    error = _identity_error(made, fitted, p)
    out = _keyed(rows).select("vec_id", "k1", "k2").join(made.drop("weight"), ["k1", "k2"])
    explained = F.array(*(F.lit(float(e)) for e in fitted.explained))
    return out.select("vec_id", "deviation", "whitened", F.lit(fitted.n).cast("long").alias("n"), explained.alias("explained"), F.lit(error).alias("identity_error"))


def whitened_components(vectors: DataFrame, p: WhiteningParams | None = None) -> DataFrame:
    """A row for each usable vector and component, numbered from 1."""
    rows = whiten(vectors, p)
    out = rows.select("vec_id", F.posexplode("whitened").alias("_at", "z"), "n", "deviation", "explained", "identity_error")
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("_at") + 1).cast("int").alias("component"), "n", "deviation", F.col("z").alias("whitened"), F.get("explained", F.col("_at")).alias("explained"), "identity_error")
