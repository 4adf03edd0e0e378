"""Ordered rows: runs, chunks, ranges, greedy rows and piles, nearest partners, alignment, medoids.

What a window or a join can say is said so.  Greedy layouts depend on all that came before, so
they run group by group over Arrow batches; a group is one shelf, pile or recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.storage import dealt

#: Rows that one task sorts, about.
TASK_ROWS = 1_000_000


def without_repeats(df: DataFrame, group: str, order: list[Column], value: Column) -> DataFrame:
    """Rows whose value differs from that of the row before in their group."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = df.withColumn("_v", value).withColumn("_p", F.lag("_v").over(w)).withColumn("_i", F.row_number().over(w))
    return marked.where((F.col("_i") == 1) | ~F.col("_v").eqNullSafe(F.col("_p"))).drop("_v", "_p", "_i")


def run_hulls(df: DataFrame, group: str, start: str, end: str, gap: float = 0.0) -> DataFrame:
    """(group, start, end, n): intervals that overlap, or lie within ``gap``, as one."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-df.count() // TASK_ROWS))
    df = df.select(group, start, end).repartition(parts, group)  # a task's rows stay as many however large the table is
    w = Window.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce(F.col(start) > reach + gap, F.lit(True)).cast("int"))
    named = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(group, "_run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_run")


def between_anchors(df: DataFrame, group: str, order: list[Column], anchor: Column) -> DataFrame:
    """Rows from the first to the last anchor of their group, both included."""
    w = Window.partitionBy(group).orderBy(*order)
    all_ = Window.partitionBy(group)
    placed = df.withColumn("_i", F.row_number().over(w)).withColumn("_a", F.when(anchor, F.col("_i")))
    return placed.withColumn("_lo", F.min("_a").over(all_)).withColumn("_hi", F.max("_a").over(all_)).where("_i between _lo and _hi").drop("_i", "_a", "_lo", "_hi")


def chunked(df: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """``df`` with chunk and place (both from 0) of each row in its group."""
    i = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return df.withColumn("chunk", F.floor(i / size).cast("int")).withColumn("place", (i % size).cast("int"))


def piles(df: DataFrame, group: str, order: list[Column], each: int, most: int) -> DataFrame:
    """Chunks of ``each`` rows, ``most`` of them at most; the rest is ``hidden``."""
    return chunked(df, group, order, each).withColumn("hidden", F.col("chunk") >= most)


def _scanned(df: DataFrame, group: str, order: list[str], value: str, take) -> DataFrame:
    """(group, order, row, at) by a walk along each group: ``take`` gives the two of a value after the state before it, and the state after.

    Rows stream through their task in order, many groups to a batch; what is kept is a state.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for part in parts:
            rows, at = [], []
            for v, first in zip(part["_v"].tolist(), part["_first"].tolist(), strict=True):
                row, x, state = take(v, None if first else state)
                rows.append(row)
                at.append(x)
            yield part[[group, *order]].assign(row=np.array(rows, np.int32), at=np.array(at, float))

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (group, *order))
    last = [F.col(c).asc_nulls_last() for c in order]
    rows = dealt(df.select(group, *order, F.col(value).cast("double").alias("_v")), group)
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(*last))).sortWithinPartitions(group, "_i")
    return rows.select(group, *order, "_v", (F.col("_i") == 1).alias("_first")).mapInPandas(run, f"{kinds}, row int, at double")


def packed_rows(df: DataFrame, group: str, order: list[str], width: str, room: float, gap: float) -> DataFrame:
    """(group, order, row, at): items set side by side, a new row where the next one does not fit; a wider item than the room stands alone."""

    def take(w: float, state: tuple[int, float] | None) -> tuple[int, float, tuple[int, float]]:
        row, x = state or (0, 0.0)
        if x > 0 and x + w > room:
            row, x = row + 1, 0.0
        return row, x, (row, x + w + gap)

    return _scanned(df, group, order, width, take)


def piled_up(df: DataFrame, group: str, order: list[str], height: str, most: float, count: int) -> DataFrame:
    """(group, order, row, at): items laid on one another, a new pile beyond a height or a number of items."""

    def take(h: float, state: tuple[int, float, int] | None) -> tuple[int, float, tuple[int, float, int]]:
        pile, y, n = state or (0, 0.0, 0)
        if n and (y + h > most or n >= count):
            pile, y, n = pile + 1, 0.0, 0
        return pile, y, (pile, y + h, n + 1)

    return _scanned(df, group, order, height, take)


def budgeted(df: DataFrame, group: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """(group, order, row, at): batches in order whose costs stay within a budget; a dearer item is a batch of its own."""
    return packed_rows(df, group, order, cost, budget, 0.0)


def nearest_within(left: DataFrame, right: DataFrame, group: str, at: str, tolerance: float) -> DataFrame:
    """``left`` with the place of the nearest right row of its group within ``tolerance`` (null without one); ties go to the lesser place.

    Both sides are sorted once together; each row looks at its neighbours of the other side.
    """
    both = left.withColumn("_r", F.lit(None).cast("double")).unionByName(right.select(group, at, F.col(at).cast("double").alias("_r")), allowMissingColumns=True)
    w = Window.partitionBy(group).orderBy(at)
    low = F.last("_r", True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    high = F.first("_r", True).over(w.rangeBetween(0, Window.unboundedFollowing))
    seen = both.withColumn("_lo", low).withColumn("_hi", high).where("_r is null")
    down, up = F.col(at) - F.col("_lo"), F.col("_hi") - F.col(at)
    best = F.when(F.col("_hi").isNull() | (down <= up), F.col("_lo")).otherwise(F.col("_hi"))
    return seen.withColumn("nearest", F.when(F.abs(best - F.col(at)) <= tolerance, best)).drop("_r", "_lo", "_hi")


def continued(df: DataFrame, group: str, frame: str, start: str, end: str, least: float) -> DataFrame:
    """(group, frame, start, end, before): the interval of the frame before that an interval continues: most overlap, ``least`` of the shorter at least.

    Each earlier interval is continued once, by the one that overlaps it most (ties to the lesser start, then end); an
    interval whose best one is taken by another begins anew.
    """
    now = df.select(group, frame, start, end)
    old = df.select(F.col(group), (F.col(frame) + 1).alias(frame), F.col(start).alias("_s"), F.col(end).alias("_e"))
    overlap = F.least(end, "_e") - F.greatest(start, "_s")
    share = overlap / F.greatest(F.lit(1.0), F.least(F.col(end) - F.col(start), F.col("_e") - F.col("_s")))
    met = now.join(old, [group, frame]).where(share >= least)
    claim = met.groupBy(group, frame, start, end).agg(F.min(F.struct((-share).alias("m"), F.col("_s").alias("s"), F.col("_e").alias("e"))).alias("_b"))
    one = claim.groupBy(group, frame, "_b.s", "_b.e").agg(F.min(F.struct(F.col("_b.m").alias("m"), F.col(start).alias("_x"), F.col(end).alias("_y"))).alias("_c"))
    best = one.select(group, frame, F.col("_c._x").alias(start), F.col("_c._y").alias(end), F.col("s").alias("before"))
    return now.join(best, [group, frame, start, end], "left")


def orders_filled(df: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``name``: the value, or where it is null one more than the greatest so far in its group (filled ones count), from 1."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # With c nulls so far the greatest is c more than the greatest value, each less the nulls before it.
    rows = df.withColumn("_c", F.count(F.when(F.col(value).isNull(), 1)).over(w))
    most = F.greatest(F.coalesce(F.max(F.col(value) - F.col("_c")).over(w), F.lit(0)), F.lit(0))
    return rows.withColumn(name, F.coalesce(F.col(value), most + F.col("_c"))).drop("_c")


def filled_forward(df: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``name``: the value, or where it is null the last one before in the group, or the first one after if there is none before."""
    w = Window.partitionBy(group).orderBy(*order)
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(name, F.coalesce(before, after))


def pan_offsets(df: DataFrame, group: str, frame: str, shift: str) -> DataFrame:
    """(group, frame, offset): running sum of each frame's median shift; the first frame lies at its own."""
    step = df.groupBy(group, frame).agg(F.median(shift).alias("_m"))
    w = Window.partitionBy(group).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    return step.select(group, frame, F.sum("_m").over(w).alias("offset"))


def rising(df: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``name``: the greatest value so far, so that progress never falls back."""
    return df.withColumn(name, F.max(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def completion_due(df: DataFrame, group: str, at: str, running: Column, wait: float) -> DataFrame:
    """(group, due): when a group without running work may be closed: ``wait`` seconds after its last event."""
    out = df.groupBy(group).agg(F.max(at).alias("_last"), F.max(running.cast("int")).alias("_busy"))
    return out.where("_busy = 0").select(group, (F.col("_last") + wait).alias("due"))


def slice_of(df: DataFrame, order: list[str], first: int, rows: int, around: int = 0) -> DataFrame:
    """Rows of a view of a sorted table, with ``around`` more on either side; positions are numbered without a task that holds the table."""
    from vellum.operators.sequences import with_position

    return with_position(df, order).where(F.col("position").between(max(0, first - around), first + rows + around - 1))


def with_leftovers(items: DataFrame, key: str, groups: DataFrame, group: str) -> DataFrame:
    """(group, n, known): items of each group, groups without items, and the keys of items whose group is gone (``known`` false)."""
    counts = items.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    named = groups.select(F.col(group).alias("_g")).distinct()
    out = counts.join(named, F.col("_k").eqNullSafe(F.col("_g")), "full")
    return out.select(F.coalesce("_g", "_k").alias(group), F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").isNotNull().alias("known"))


def medoids(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """(group, value, cost): of each group's distinct values the one of least weighted edit distance to all; ties to the greater weight, then the lesser value.

    Values meet within their group; a group holds the variants of one reading.
    """
    one = df.groupBy(group, value).agg(F.sum(weight).alias("_w"))
    x, y = one.select(group, F.col(value).alias("_x"), F.col("_w").alias("_wx")), one.select(group, F.col(value).alias("_y"), F.col("_w").alias("_wy"))
    cost = F.sum(F.col("_wy") * (F.levenshtein("_x", "_y") / F.greatest(F.length("_x"), F.length("_y"), F.lit(1))))
    costs = x.join(y, group).groupBy(group, "_x", "_wx").agg(F.round(cost, 9).alias("cost"))
    best = F.min(F.struct("cost", (-F.col("_wx")).alias("w"), F.col("_x").alias("x")))
    return costs.groupBy(group).agg(best.alias("_b")).select(group, F.col("_b.x").alias(value), F.col("_b.cost").alias("cost"))


def most_frequent(df: DataFrame, group: str, value: str, weight: str, order: str) -> DataFrame:
    """(group, value, n): the value read most often; ties to the greater weight, then the earliest reading."""
    one = df.groupBy(group, value).agg(F.count("*").alias("n"), F.sum(weight).alias("_w"), F.min(order).alias("_o"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.round("_w", 9)).alias("w"), "_o", F.col(value).alias("v")))
    return one.groupBy(group).agg(best.alias("_b")).select(group, F.col("_b.v").alias(value), (-F.col("_b.n")).alias("n"))


def spread(df: DataFrame, group: str, at: str) -> DataFrame:
    """(group, n, mean, variance, median) of a column; the variance is that of the whole group."""
    return df.groupBy(group).agg(F.count(at).alias("n"), F.avg(at).alias("mean"), F.var_pop(at).alias("variance"), F.median(at).alias("median"))


def aligned(scores: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (i, j), both rising, of greatest total score; pairs below ``least`` are not matched."""
    m, n = scores.shape
    best = np.zeros((m + 1, n + 1))
    for i in range(m):
        gain = np.where(scores[i] >= least, best[i, :-1] + scores[i], -np.inf)
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], gain))
    out, i, j = [], m, n
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return out[::-1]


def align_frames(df: DataFrame, group: str, frame: str, place: str, title: str, least: float = 0.6) -> DataFrame:
    """(group, a, b, score): rows of neighbouring frames that go together in order, by the likeness of their titles.

    Likeness is worked out by Spark over pairs of neighbouring frames; only the alignment of two
    frames, which is a recurrence, runs in Python, on one pair of frames at a time.  Needs ``id``.
    """
    from vellum.functions import text

    now = df.select(group, frame, "id", F.col(place).alias("i"), text.title_key(F.col(title)).alias("x"))
    after = df.select(group, (F.col(frame) - 1).alias(frame), F.col("id").alias("id2"), F.col(place).alias("j"), text.title_key(F.col(title)).alias("y"))
    met = now.join(after, [group, frame]).select(group, frame, "id", "id2", "i", "j", text.edit_ratio(F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= least)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        i, j = (pd.factorize(part[c], sort=True)[0] for c in ("i", "j"))
        scores = np.zeros((i.max() + 1, j.max() + 1))
        scores[i, j] = part["score"]
        at = {(a, b): k for k, (a, b) in enumerate(zip(i, j, strict=True))}
        return part.iloc[[at[p] for p in aligned(scores, least)]]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([group, frame, "i", "j"], kind="stable").reset_index(drop=True)
        new = (part[[group, frame]] != part[[group, frame]].shift()).any(axis=1).to_numpy()
        first = np.append(np.flatnonzero(new), len(part))
        found = [part.iloc[a:b] if b - a == 1 else one(part.iloc[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        return pd.concat(found)[[group, "id", "id2", "score"]].set_axis([group, "a", "b", "score"], axis=1)

    kind, of = df.schema[group].dataType.simpleString(), df.schema["id"].dataType.simpleString()
    # Many small pairs of frames share a task; a pair is never cut.
    parts = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return met.groupBy(F.pmod(F.xxhash64(group, frame), F.lit(parts))).applyInPandas(run, f"`{group}` {kind}, a {of}, b {of}, score double")
