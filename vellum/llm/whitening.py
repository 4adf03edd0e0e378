"""Whitening: centred vectors on the covariance's eigenvectors, each with variance one.

MLlib's ``computeSVD`` decomposes the distributed centred rows; a singular value s of n rows
gives the eigenvalue s * s / n of the covariance with divisor n.  The total variance does not
come from the singular values but from whole-number deviations of the rows, so ``explained``
is also a check of the decomposition.

Scale: the rows are read once for the sums, once for MLlib's matrix of products (summed by
trees), once for the total variance, twice for the check and once for the result.  Nothing is
shuffled but sums; the driver holds the d x d products of d dimensions and the d x k
components.

Defined cases: vectors that are null, or hold null or non-finite entries, are dropped, as are
those whose length is not the most frequent one (of equally frequent lengths the greater):
they lack entries or have too many.  Rows of equal or null ids are rows of their own; further
columns are not read.  Components without variance (by ``NO_VARIANCE``) are left out: they
cannot be scaled, so an empty table, a single row or equal rows give nothing.  Entries so
large that whole numbers of 64 bits cannot hold them raise an error; a deviation past 64 bits is
null in ``deviation``, ``deviation_exact`` has it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMES, PLUS = 1024, 100_000  #: an entry c becomes floor(TIMES * c) + PLUS
COMPONENTS = 8
NO_VARIANCE = 1e-7  #: least singular value told, as a part of the greatest
_HALF = 10**15  #: deviations are summed in two parts, so that no sum passes 38 digits


@dataclass(frozen=True)
class Whitening:
    """n vectors' sums by dimension, unit components (columns) by falling eigenvalue, and the total variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    total: float

    def whitened(self, x: Column) -> Column:
        """The array of a whole-number vector's whitened values."""
        return F.array(*[_dot(_centred(x, self), self.components[:, j] / np.sqrt(self.eigenvalues[j])) for j in range(len(self.eigenvalues))])


def _centred(x: Column, of: Whitening) -> Column:
    """x - S/n with one rounding."""
    return F.transform(_deviations(x, of.n, of.sums), lambda v: v.cast("double") / F.lit(float(of.n)))


def _deviations(x: Column, n: int, sums: Sequence[int]) -> Column:
    return F.zip_with(x, F.array(*[F.lit(s).cast("long") for s in sums]), lambda v, s: v * F.lit(n).cast("long") - s)


def _dot(x: Column, weights: np.ndarray) -> Column:
    products = F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)


def deviation(x: Column, n: int, sums: Sequence[int]) -> Column:
    """Sum of (n * x - S)^2 over the dimensions, exact."""
    wide = F.transform(_deviations(x, n, sums), lambda v: v.cast("decimal(19,0)"))
    return F.aggregate(wide, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v * v).cast("decimal(38,0)"))


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the vectors that take part, as whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    strange = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    good = rows.where(v.isNotNull() & ~strange)
    lengths = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    whole = F.transform(v, lambda c: F.floor(c * F.lit(float(TIMES))).cast("long") + F.lit(PLUS).cast("long"))
    return good.where((F.size(v) == d) & (F.size(v) > 0)).select(F.col(id_col).alias("id"), whole.alias("x"))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Learns from all rows of ``whole_vectors``."""
    none = Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    head = vectors.select(F.size("x").alias("d")).first()
    if head is None:
        return none
    d = head["d"]
    found = vectors.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d)]).first()
    n, sums = found["n"], tuple(found[f"s{i}"] for i in range(d))
    total = _total_variance(vectors, n, sums)
    if not total:
        return none
    base = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), total)
    centred = vectors.select(array_to_vector(_centred(F.col("x"), base)).alias("row"))
    # All d: asked for few, computeSVD would iterate to a tolerance of 1e-10 instead of decomposing the products.
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row"), 0, d).computeSVD(d, computeU=False, rCond=NO_VARIANCE)
    singular, v = svd.s.toArray()[:components], svd.V.toArray()[:, :components]
    signs = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return Whitening(n, sums, v * signs, singular**2 / n, total)


def _total_variance(vectors: DataFrame, n: int, sums: Sequence[int]) -> float:
    """Trace of the covariance from exact deviations: their sum over n^3."""
    each = vectors.select(deviation(F.col("x"), n, sums).alias("e"))
    half = F.lit(_HALF).cast("decimal(16,0)")
    high = F.call_function("div", F.col("e"), half).cast("decimal(28,0)")
    low = (F.col("e") % half).cast("decimal(28,0)")
    found = each.agg(F.sum(high).alias("high"), F.sum(low).alias("low")).first()
    exact = int(found["high"]) * _HALF + int(found["low"])
    return exact / n**3


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry, by size, of the whitened rows' covariance (divisor n, centred) minus the identity."""
    k = len(model.eigenvalues)
    w = vectors.select(model.whitened(F.col("x")).alias("w")).select(*[F.get("w", F.lit(i)).alias(f"w{i}") for i in range(k)])
    means = w.agg(*[F.avg(f"w{i}").alias(f"w{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    centred = {i: F.col(f"w{i}") - F.lit(float(means[i])) for i in range(k)}
    found = w.agg(*[(F.sum(centred[i] * centred[j]) / F.lit(float(model.n))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def op12(embeddings: DataFrame) -> DataFrame:
    vectors = whole_vectors(embeddings.select("vec_id", "embedding"))
    model = fit(vectors)
    k = len(model.eigenvalues)
    error = identity_error(vectors, model) if k else 0.0
    exact = deviation(F.col("x"), model.n, model.sums) if k else F.lit(None).cast("decimal(38,0)")
    white = model.whitened(F.col("x")) if k else F.array().cast("array<double>")
    told = vectors.select("id", exact.alias("deviation_exact"), F.posexplode(white).alias("place", "whitened"))
    explained = F.array(*[F.lit(float(e / model.total)) for e in model.eigenvalues]) if k else F.array().cast("array<double>")
    return told.select(
        F.col("id").alias("vec_id"),
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation_exact AS long)").alias("deviation"),
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
        "deviation_exact",
    )
