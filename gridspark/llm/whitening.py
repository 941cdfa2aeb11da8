"""Whitening of embeddings with a covariance that Spark SQL sums pair by pair.

1. Entries become whole numbers. One aggregation gives the count of vectors and the sum of each dimension.
2. A second one gives the upper triangle of the covariance. Each vector is laid out once for each dimension i, and a
   generated expression for each diagonal t sums the products of the centred values of i and i + t; beyond the last
   dimension there is none. A sum for each of the 2,080 pairs of 64 dimensions beside each other is the same, but makes
   code too long to be compiled, which took 50 times as long.
3. LAPACK decomposes the covariance, whose size depends on the dimensions alone; vectors are projected in batches.
A third aggregation over the whitened values gives how far their covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.common import written

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: the count of vectors, the sum of each dimension, the eigenvalues above 0 in falling order, their
    unit eigenvectors as columns, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, deviations: np.ndarray, components: int) -> np.ndarray:
        """Whitened values of vectors, given as n * x - S: a row for each vector, a column for each component."""
        k = min(components, len(self.values))
        return (deviations / self.n) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def whole_vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """The other columns, and x: the entries as whole numbers. Vectors that are null, or hold null or non-finite entries,
    go; so do those without entries or with another number of them than most have (of equally frequent numbers the larger
    one counts)."""
    vector = F.col(column)
    finite = lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))  # noqa: E731 (NaN is above infinity)
    rows = embeddings.filter(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite))
    sizes = rows.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    whole = lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long")
    x = F.transform(vector, lambda c: F.when(finite(c), whole(c)))  # Spark may compute it before the filter
    return rows.filter(F.size(vector) == (sizes["size"] if sizes else 0)).withColumn("x", x).drop(column)


def upper_triangle(vectors: DataFrame, d: int, column: str = "c") -> np.ndarray:
    """Sums of the products of each two entries of an array column, as a symmetric matrix, in one aggregation."""
    diagonals = [F.expr(f"sum(_a * get({column}, _i + {t})) AS s{t}") for t in range(d)]
    laid_out = vectors.select(column, F.posexplode(column).alias("_i", "_a"))
    out = np.zeros((d, d))
    for row in laid_out.groupBy("_i").agg(*diagonals).collect():  # a row for each dimension
        i = row["_i"]
        out[i, i:] = [row[f"s{t}"] for t in range(d - i)]
    return out + np.triu(out, 1).T


def fit(vectors: DataFrame) -> Whitening:
    """The whitening of whole vectors x. An eigenvalue that isn't above the rounding of the largest one counts as 0; its
    component is left out."""
    entries = vectors.select(F.posexplode("x").alias("i", "x"))
    sums = entries.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s")).orderBy("i").collect()  # a row for each dimension
    if not sums:
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
    n, s, d = sums[0].n, [r.s for r in sums], len(sums)
    centred = vectors.select(F.transform(_deviations(n, s), lambda v: v.cast("double") / F.lit(float(n))).alias("c"))
    cov = upper_triangle(centred, d) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    rank = int((values > max(values[0], 0) * d * np.finfo(float).eps).sum())
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)  # one sign for every run
    return Whitening(n, np.array(s), values[:rank], axes[:, :rank], float(np.trace(cov)))


def _deviations(n: int, sums: list[int]):
    """n * x - S, exact, as an array column."""
    return F.zip_with("x", F.lit(sums), lambda x, s: x * F.lit(n).cast("long") - s)


def transform(vectors: DataFrame, fitted: Whitening, components: int) -> DataFrame:
    """The columns of whole vectors without x, deviation (the exact sum over dimensions of (n * x - S) ** 2), and whitened,
    an array of the whitened values of the first components."""
    off = vectors.withColumn("_d", _deviations(fitted.n, fitted.sums.tolist())).drop("x")
    square = F.aggregate("_d", F.lit(0).cast("long"), lambda held, d: held + d * d)
    rows = off.withColumn("deviation", square).withColumn("_d", F.col("_d").cast("array<double>"))
    rows = rows.select(*[c for c in rows.columns if c != "_d"], "_d")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(fitted.sums))
            w = fitted.project(d, components)
            offsets = np.arange(0, w.size + 1, max(w.shape[1], 1), dtype=np.int32) if w.size else np.zeros(batch.num_rows + 1, np.int32)
            whitened = pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], whitened], names=[*batch.schema.names[:-1], "whitened"])

    schema = rows.drop("_d").schema.add("whitened", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(project, schema)


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of the array column whitened minus the identity."""
    means = whitened.agg(*[F.sum(F.get("whitened", F.lit(j))).alias(f"m{j}") for j in range(k)]).first()
    centred = whitened.select(F.zip_with("whitened", F.lit([m / n for m in means]), lambda w, m: w - m).alias("c"))
    return float(np.abs(upper_triangle(centred, k) / n - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = 8, column: str = "embedding") -> DataFrame:
    """A row for each vector and component up to `components`: vec_id, component (from 1), n, deviation, whitened,
    explained (share of the eigenvalue in the trace) and identity_error.

    The whitening is fitted to all vectors that remain, repeated ones as often as they occur; they may share a vec_id,
    or have none. Vectors that are null, hold null or non-finite entries, or have another number of entries than most,
    go. Components whose eigenvalue is 0 are left out: with equal vectors alone, or none, there are no rows. Entries so
    large that a sum passes 64 bits raise an error. Other columns are ignored, whatever their names.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("_vector"))
    vectors = whole_vectors(rows, "_vector")
    fitted = fit(vectors)
    k = min(components, len(fitted.values))
    if not k:
        names = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return embeddings.sparkSession.createDataFrame([], names)
    whitened = written(transform(vectors, fitted, components), "whitened")
    error = identity_error(whitened, fitted.n, k)
    explained = F.get(F.lit([float(v / fitted.trace) for v in fitted.values[:k]]), F.col("_k"))
    out = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    numbers = [(F.col("_k") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n")]
    return out.select("vec_id", *numbers, "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
