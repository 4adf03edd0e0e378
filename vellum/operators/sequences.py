"""Sequence operators: best of a group, islands, sessions, windows of rows, positions, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.storage import staged


def first_of(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group.  An aggregate of structs, so that rows are combined before the shuffle."""
    best = df.groupBy(*group).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def sessions(df: DataFrame, group: str, order: list[Column], starts: Column) -> DataFrame:
    """``session`` from 0 in each group; ``starts`` says of a row (after the first) that it opens one."""
    w = Window.partitionBy(group).orderBy(*order)
    opened = F.when(F.row_number().over(w) == 1, 0).otherwise(F.when(starts, 1).otherwise(0))
    return df.withColumn("_opened", opened).withColumn("session", F.sum("_opened").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_opened")


def islands(df: DataFrame, group: str, day: str) -> DataFrame:
    """(group, first, last, days) of each run of consecutive days."""
    days = df.select(group, day).distinct()
    anchor = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(group).orderBy(day)))
    return days.withColumn("_a", anchor).groupBy(group, "_a").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("days")).drop("_a")


def window_argmax(df: DataFrame, index: str, size: int, value: str) -> DataFrame:
    """Of each ``size`` rows by a dense index the one of greatest value, ties to the earliest."""
    return first_of(df.withColumn("_w", F.floor(F.col(index) / size)), ["_w"], [-F.col(value), F.col(index)]).drop("_w")


def moving_average(df: DataFrame, group: str, order: list[Column], value: Column, radius: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(-radius, radius)))


def rank_in_block(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(group)
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order)) - 1).withColumn("block_size", F.count("*").over(w))


def with_position(df: DataFrame, order: list[str]) -> DataFrame:
    """``position`` from 0 in the order of the whole table, without a task that holds it.

    Rows are dealt by ranges and sorted; a partition's positions begin where those before
    it end.  The dealt rows are written once, so both passes see the same ranges.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(dealt.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each range
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return rows.join(F.broadcast(starts), "_p").withColumn("position", F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def uniform_sample(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """``k`` rows evenly spaced in the order, first and last among them; all if there are no more."""
    rows = with_position(df, order)
    n = rows.count()
    if n <= k:
        return rows.drop("position")
    at = F.array(*[F.lit(int(i * (n - 1) / (k - 1) + 0.5)).cast("long") for i in range(k)]) if k > 1 else F.array(F.lit(0).cast("long"))
    return rows.where(F.array_contains(at, F.col("position"))).drop("position")


def overlapping_batches(df: DataFrame, order: list[str], size: int, overlap: int) -> DataFrame:
    """Rows with ``batch``: each holds ``size`` rows and begins with the last ``overlap`` of the one before; no batch is inside the one before."""
    rows = with_position(df, order)
    n, step = rows.count(), size - overlap
    last = max(0, -(-(n - size) // step))
    p = F.col("position")
    first = F.greatest(F.lit(0), F.ceil((p - (size - 1)) / step)).cast("int")
    until = F.least(F.lit(last), F.floor(p / step)).cast("int")
    return rows.withColumn("batch", F.explode(F.sequence(first, until)))


def redundancy_filter(df: DataFrame, group: str, order: list[str], value: str, threshold: float, gap: float) -> DataFrame:
    """Rows kept by a scan of each group: the first, the last, and those that differ from the last KEPT one by
    ``threshold`` or come ``gap`` (of the first order column) after it; further order columns part ties.  The scan needs
    one row of state, so a group streams through its task in batches; no group is held whole."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept, waiting = None, None, None  # waiting: the last row of the batch before, if it was not kept
        for part in parts:
            take, last = [], None
            for i, (g, o, v) in enumerate(zip(part[group], part[order[0]], part[value], strict=True)):
                if g != now:
                    if last is not None:
                        take.append(last)
                    elif waiting is not None:
                        yield waiting
                    now, kept, last, waiting = g, (o, v), None, None
                    take.append(i)
                elif abs(v - kept[1]) >= threshold or o - kept[0] > gap:
                    kept, last, waiting = (o, v), None, None
                    take.append(i)
                else:
                    last = i
            if last is not None:
                waiting = part.iloc[[last]]
            yield part.iloc[take]
        if waiting is not None:
            yield waiting

    return df.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, df.schema)
