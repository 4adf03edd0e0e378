"""Motion between two frames: the shift of their profiles, and the line through matched positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

#: Least part of a profile that must overlap; weight of a slope beside a level; shifts within which peaks are one.
OVERLAP, SLOPE, NEAR = 0.25, 3.0, 4
# Residuals always allowed, and by medians of all; the zoom between two frames that is believed.
ALLOWED, MEDIANS, ZOOM = 6.0, 2.5, (0.9, 1.1)


def features(level: np.ndarray) -> np.ndarray:
    """A profile and its slope."""
    slope = np.zeros(len(level))
    slope[1:-1] = (level[2:] - level[:-2]) / 2
    return np.stack([level, slope])


def estimate(a: np.ndarray, b: np.ndarray, overlap: float = OVERLAP, ends: bool = True) -> tuple[int, float, float] | None:
    """(shift, score, margin): what lies at p in ``a`` lies at p + shift in ``b``, by normalised correlation; None for profiles too short.

    The slope at an end of a profile is none; without ``ends`` slopes are compared only where both sides have one, so that a profile
    that is cut out of a longer one agrees with it wholly.
    """
    n = min(len(a), len(b))
    least = max(4, int(np.floor(n * overlap + 0.5)))
    if n < least:
        return None
    fa, fb, weight = features(a[:n].astype(float)), features(b[:n].astype(float)), np.array([1.0, SLOPE])
    shifts, scores = np.arange(-(n - least), n - least + 1), []
    for d in shifts:
        x, y = fa[:, max(0, -d) : n - max(0, d)], fb[:, max(0, d) : n + min(0, d)]
        if ends:
            x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
            parts = [float((weight * (p * q).sum(axis=1)).sum()) for p, q in ((x, y), (x, x), (y, y))]
        else:
            x, y = ([v[0] - v[0].mean(), v[1, 1:-1] - v[1, 1:-1].mean()] for v in (x, y))
            parts = [float(sum(w * (p @ q) for w, p, q in zip(weight, s, t, strict=True))) for s, t in ((x, y), (x, x), (y, y))]
        scores.append(parts[0] / np.sqrt(parts[1] * parts[2] + 1e-9))
    s = np.array(scores)
    peak = np.flatnonzero(np.append(True, s[1:] >= s[:-1]) & np.append(s[:-1] >= s[1:], True))
    order = peak[np.argsort(-s[peak], kind="stable")]
    others = [i for i in order if abs(shifts[i] - shifts[order[0]]) > NEAR]
    return int(shifts[order[0]]), float(s[order[0]]), float(s[order[0]] - (s[others[0]] if others else -1.0))


_ESTIMATE = StructType([StructField("shift", IntegerType()), StructField("score", DoubleType()), StructField("margin", DoubleType())])


def _estimates(a: pd.Series, b: pd.Series, ends: bool) -> pd.DataFrame:
    found = [None if x is None or y is None else estimate(np.asarray(x), np.asarray(y), ends=ends) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame([f or (None, None, None) for f in found], columns=["shift", "score", "margin"])


@F.pandas_udf(_ESTIMATE)
def shift(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """``estimate`` of two columns of profiles; nulls where there is none."""
    return _estimates(a, b, True)


@F.pandas_udf(_ESTIMATE)
def shift_of_cuts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """``estimate`` of two columns of cuts from longer profiles, without the slopes at their ends; nulls where there is none."""
    return _estimates(a, b, False)


def _fitted(kept: DataFrame, w: WindowSpec) -> DataFrame:
    """``kept`` with n, med, s and d of its group: least squares of y on x, a slope beyond belief as 1; and the median of y - x."""
    many, xx = F.count("*").over(w), F.var_pop("x").over(w)
    fit = kept.withColumns({"n": many, "med": F.median(F.col("y") - F.col("x")).over(w), "_xy": F.covar_pop("x", "y").over(w), "_xx": xx, "_mx": F.avg("x").over(w), "_my": F.avg("y").over(w)})
    slope = F.when(F.col("_xx") * F.col("n") > 1e-6, F.col("_xy") / F.col("_xx")).otherwise(1.0)
    fit = fit.withColumn("s", F.when((slope > ZOOM[0]) & (slope < ZOOM[1]), slope).otherwise(1.0))
    return fit.withColumn("d", F.col("_my") - F.col("s") * F.col("_mx")).drop("_xy", "_xx", "_mx", "_my")


def robust_lines(pairs: DataFrame, group: str, rounds: int = 2) -> DataFrame:
    """(group, s, d, matches): y = s x + d through each group's pairs (x, y).

    From four pairs on by least squares, fitted again without pairs whose residual passes ``MEDIANS`` medians (and ``ALLOWED``), as long as
    that drops any and leaves four; two or three pairs give the median shift, one none.  A group's pairs meet once: all rounds
    are windows over one partitioning.
    """
    w = Window.partitionBy(group)
    fit = _fitted(pairs.select(group, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), w)
    for _ in range(rounds):
        off = fit.withColumn("_r", F.abs(F.col("y") - (F.col("s") * F.col("x") + F.col("d"))))
        judged = off.withColumn("_in", F.col("_r") <= F.greatest(F.lit(ALLOWED), MEDIANS * F.median("_r").over(w))).withColumn("_left", F.count_if("_in").over(w))
        # A group that keeps all of its pairs, or too few, stays as it is, in this round and the next.
        fit = _fitted(judged.where(F.col("_in") | (F.col("_left") < 4)).select(group, "x", "y"), w)
    few = F.col("n") < 4
    one = fit.where("n >= 2").groupBy(group).agg(*[F.first(c).alias(c) for c in ("n", "med", "s", "d")])
    return one.select(group, F.when(few, 1.0).otherwise(F.col("s")).alias("s"), F.when(few, F.col("med")).otherwise(F.col("d")).alias("d"), F.col("n").alias("matches"))
