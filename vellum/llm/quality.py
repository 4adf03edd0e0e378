"""Quality scores from preferences: a Bradley-Terry model on text features.

A good text is preferred to a bad one; the probability of that is the logistic of
the difference of their scores, and a score is linear in the features.  All labelled
rows are learnt from: they are dealt to groups of about ``GROUP``, each row of a group
stands in a pair, and Newton steps on the logistic loss of feature differences add up
the sums that tasks return.  The threshold is the quantile of all their scores that
matches their share of bad texts; scores are mapped to (0, 1) so that it falls on ``CUT``.

Features come from the whole text: shares of characters (each ASCII sign, capitals,
digits, non-ASCII), words (length, distinct share, repeats of the word before) and
lines.  They are computed once, in one pass, and kept (a few dozen floats a row).

Defined cases: null text is empty; an empty text has zero features and is scored as
any other; rows without label, or with a null one, are not learnt from; a label that stands
twice counts twice, of several rows of one id the one of least features is learnt from;
without both labels every score is ``CUT``; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.common import crc32_mod, saved

GROUP = 4_000  #: labelled rows that are paired with one another
RARE = 20  #: rows of a class in a group; a class of fewer goes to several groups
PAIRS = 100_000  #: pairs at least, and two for a row
CUT = 0.3
SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
NAMES = [
    "log_chars", "capitals", "digits", "beyond_ascii", "signs", "spaces", "log_words", "word_length", "distinct_words",
    "repeats", "top_word", "signed_ends", "log_lines", "distinct_lines", "line_words", "all_capitals", *(f"sign_{c}" for c in SIGNS),
]


def features(text: str) -> np.ndarray:
    out = np.zeros(len(NAMES))
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return out
    n = len(raw)
    at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    capitals, small, digits = at[65:91].sum(), at[97:123].sum(), at[48:58].sum()
    letters = max(1, capitals + small)
    signs = at[SIGNS]
    words = text.split()
    count = max(1, len(words))
    distinct = set(words)
    lines = [x for x in text.split("\n") if x]
    repeats = sum(map(eq, words, words[1:]))
    ends = sum(1 for w in distinct if not w[-1].isalnum() and w[-1] not in ".,;:")
    out[:16] = (
        np.log1p(n), capitals / letters, digits / n, at[128:].sum() / n, signs.sum() / n, (at[32] + at[10]) / n, np.log1p(len(words)),
        (n - at[32] - at[10]) / count / 10, len(distinct) / count ** 0.8, repeats / count, 1 / max(1, len(distinct)), ends / max(1, len(distinct)),
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(count / max(1, len(lines))), float(capitals > 0.6 * letters),
    )
    out[16:] = np.sqrt(signs / count)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            rows = np.array([features(t or "") for t in part.column(1).to_pylist()], np.float32).reshape(-1, len(NAMES))
            flat = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(NAMES), dtype=np.int32), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["doc_id", "f"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and its features ``f``, kept in the shared folder."""
    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measured, "doc_id long, f array<float>"), "quality-features")


class Ranking:
    """A fitted model: weights of raw features, and the scale that puts the threshold on CUT."""

    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset = weights, offset

    def dot(self, f: str = "f") -> Column:
        w = F.array(*[F.lit(float(x)) for x in self.weights])
        return F.aggregate(F.zip_with(F.col(f), w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)

    def score(self, f: str = "f") -> Column:
        return 1 / (1 + F.exp(-(self.dot(f) + F.lit(float(self.offset)))))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> Ranking:
    """Bradley-Terry by Newton's method on differences of features of preferred and other rows."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    logit = np.log(CUT / (1 - CUT))
    if not len(good) or not len(bad):
        return Ranking(np.zeros(x.shape[1]), logit)
    rng = np.random.default_rng(seed)
    spread = x.std(axis=0)
    scale = np.where(spread > 1e-6, spread, np.inf)
    z = (x - x.mean(axis=0)) / scale
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(axis=0) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-4:
            break
    s = z @ w
    # The threshold by quantile, in the widest gap of scores about it so that it is stable.
    order, k = np.sort(s), int(round(len(s) * len(bad) / len(s)))
    near = np.arange(max(1, k - len(s) // 50), min(len(s) - 1, k + len(s) // 50) + 1)
    cut = near[np.argmax(order[near] - order[near - 1])] if len(near) else k
    at = (order[cut] + order[cut - 1]) / 2 if 0 < cut < len(order) else order[0]
    return Ranking(w / scale, logit - at - float((x.mean(axis=0) / scale) @ w))


def _summed(packed: DataFrame, f) -> np.ndarray:
    """The sum of ``f(group, y, x)`` over all groups of labelled rows: a task returns one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for g, rows in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                flat = rows.values.flatten()
                x = flat[2].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(float)
                part = f(g, flat[1].to_numpy(zero_copy_only=False), x)
                out = part if out is None else out + part
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["s"])

    return np.sum([r.s for r in packed.mapInArrow(run, "s array<double>").collect()], axis=0)


def _newton(packed: DataFrame, groups: int, mean: np.ndarray, scale: np.ndarray, ridge: float = 1e-3, seed: int = 7) -> np.ndarray:
    """``fit_pairs``'s weights from groups of rows: every row of a group stands in a pair."""
    k = len(NAMES)

    def at(w):
        def sums(g, y, x):
            good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
            out = np.zeros(1 + k + k * k)
            if len(good) and len(bad):
                rng, n = np.random.default_rng((seed, g)), max(PAIRS // groups, 2 * len(y))
                z = (x - mean) / scale
                dealt = [np.resize(rng.permutation(c), n) for c in (good, bad)]
                dealt[1] = rng.permutation(dealt[1])
                for i in range(0, n, 10_000):
                    d = z[dealt[0][i : i + 10_000]] - z[dealt[1][i : i + 10_000]]
                    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
                    out += np.concatenate([[len(d)], (d * p[:, None]).sum(axis=0), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])
            return out

        return _summed(packed, sums)

    w = np.zeros(k)
    for _ in range(25):
        s = at(w)
        step = np.linalg.solve(s[1 + k :].reshape(k, k) / s[0] + ridge * np.eye(k), -s[1 : 1 + k] / s[0] + ridge * w)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-4:
            break
    return w


def _threshold(scores: DataFrame, n: int, bad: int) -> float:
    """The score ``s`` below which ``bad`` of all ``n`` rows lie, in the widest gap of scores about it.  Rows are numbered within bins of scores."""
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    at = scores.select("s", F.floor((F.col("s") - low) / max(high - low, 1e-300) * 4096).alias("bin"))
    w = Window.orderBy("bin")  # over the bins alone
    bins = at.groupBy("bin").agg(F.count("*").alias("_n"), F.max("s").alias("_m")).select("bin", (F.sum("_n").over(w) - F.col("_n")).alias("_first"), F.lag("_m").over(w).alias("_m"))
    inside = Window.partitionBy("bin").orderBy("s")
    ranked = at.join(F.broadcast(bins), "bin").select("s", (F.col("_first") + F.row_number().over(inside) - 1).alias("i"), F.coalesce(F.lag("s").over(inside), F.col("_m")).alias("before"))
    near = ranked.where((F.col("i") >= max(1, bad - n // 50)) & (F.col("i") <= min(n - 1, bad + n // 50)))
    best = near.agg(F.max_by(F.struct("s", "before"), F.struct(F.col("s") - F.col("before"), -F.col("i")))).first()[0]
    return (best.s + best.before) / 2 if best else low


def fit(f: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> Ranking:
    """A ranking from all labelled rows of ``f`` where ``learn`` holds."""
    known = labels.where(F.col(label).isin(0, 1) & learn & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y"))
    known = saved(known, "quality-labels")  # so its size is known
    some = f.join(known.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("f").alias("f"))
    rows = saved(some.join(known, "doc_id").select("doc_id", "_y", "f"), "quality-learnt")
    counts = {r._y: r.n for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n, logit = sum(counts.values()), np.log(CUT / (1 - CUT))
    if len(counts) < 2:
        return Ranking(np.zeros(len(NAMES)), logit)
    groups = -(-n // GROUP)
    copies = {y: min(groups, max(1, -(-groups * RARE // c))) for y, c in counts.items()}
    turn = F.explode(F.sequence(F.lit(0), F.when(F.col("_y") == 0, copies[0] - 1).otherwise(copies[1] - 1))).alias("_turn")
    dealt = rows.select("doc_id", "_y", "f", turn).select(F.pmod(F.xxhash64("doc_id", "_y") + F.col("_turn"), F.lit(groups)).cast("int").alias("g"), "doc_id", "_y", "f", (F.col("_turn") == 0).cast("int").alias("_own"))
    packed = saved(dealt.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("doc_id", "_y", "f", "_own"))).alias("rows")), "quality-groups")
    flat = F.transform("rows", lambda r: F.struct(r["_own"].alias("_own"), r["_y"].alias("_y"), r["f"].alias("f")))
    packed = packed.select("g", flat.alias("rows"))
    # A row counts once in the moments, however many groups it goes to.
    own = packed.select("g", F.filter("rows", lambda r: r["_own"] == 1).alias("rows"))
    mean = _summed(own, lambda g, y, x: x.sum(axis=0)) / n
    spread = np.sqrt(_summed(own, lambda g, y, x: ((x - mean) ** 2).sum(axis=0)) / n)
    scale = np.where(spread > 1e-6, spread, np.inf)
    w = _newton(packed, groups, mean, scale) / scale
    at = _threshold(saved(rows.select(Ranking(w, 0.0).dot().alias("s")), "quality-scores"), n, counts[0])
    return Ranking(w, logit - at)


def scored(docs: DataFrame, model: Ranking, text_col: str = "text") -> DataFrame:
    """(row, score): each row of ``docs`` as a struct, and its score."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t or "").astype(np.float32) for t in texts], index=texts.index, dtype=object)

    measure = F.pandas_udf(run, "array<float>")
    return docs.select(F.struct("*").alias("row"), measure(F.col(text_col)).alias("f")).select("row", model.score().alias("score"))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False))
    f = measured(docs)
    model = fit(f, labels, ~held_out)
    return f.select("doc_id", held_out.alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
