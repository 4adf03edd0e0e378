"""Seeded draws: shuffles, picks and rows around a pick that come out the same on every run and cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import numbers
from vellum.storage import dealt


def exchanged(draws: list[int]) -> list[int]:
    """Which item ends at each place if, from the last place down, each is exchanged with the place drawn for it."""
    out = list(range(len(draws)))
    for i in range(len(out) - 1, 0, -1):
        out[i], out[draws[i]] = out[draws[i]], out[i]
    return out


def _in_groups(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` group by group, in order of their number ``_i`` there."""
    return dealt(rows, group).sortWithinPartitions(group, "_i")


def whole_groups(parts: Iterator[pd.DataFrame], least: int) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Rows of a sorted task as tables of whole groups, with where each begins (``_i`` is ``least``) and the end; many groups share a table."""
    held: list[pd.DataFrame] = []
    for part in parts:
        first = np.flatnonzero(part["_i"].to_numpy() == least)
        if not len(first):
            held.append(part)
            continue
        held.append(part.iloc[: first[-1]])
        yield _marked(held, least)
        held = [part.iloc[first[-1] :]]
    if held:
        yield _marked(held, least)


def _marked(held: list[pd.DataFrame], least: int) -> tuple[pd.DataFrame, list[int]]:
    rows = pd.concat(held, ignore_index=True)
    return rows, [*np.flatnonzero(rows["_i"].to_numpy() == least).tolist(), len(rows)]


def shuffled(df: DataFrame, group: str, order: list[str], item: str, seed: Column) -> DataFrame:
    """(group, item, position): each group shuffled by exchanges, by the numbers that its ``seed`` (32 bits, the same in all rows of a group) gives one after the other.

    The numbers come from Spark; the exchanges depend on each other, so a group's items go to one task.
    """
    w = Window.partitionBy(group)
    placed = df.select(group, item, seed.alias("_seed"), (F.row_number().over(w.orderBy(*order)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    # The last place draws first.
    drawn = placed.withColumn("_j", F.floor(numbers.seeded(F.col("_seed"), F.col("_n") - F.col("_i")) * (F.col("_i") + 1)).cast("long"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, first in whole_groups(parts, 0):
            draws, at = part["_j"].tolist(), []
            for a, b in zip(first[:-1], first[1:], strict=True):
                at += [a + i for i in exchanged(draws[a:b])]
            yield part.iloc[at][[group, item]].assign(position=part["_i"].to_numpy(np.int32))

    kind = df.schema[group].dataType.simpleString(), df.schema[item].dataType.simpleString()
    return _in_groups(drawn.select(group, item, "_i", "_j"), group).mapInPandas(run, f"`{group}` {kind[0]}, `{item}` {kind[1]}, position int")


def picked(df: DataFrame, group: str, order: list[str], item: str, seed: Column) -> DataFrame:
    """(group, item): the item of each group that its seed's first number points to."""
    w = Window.partitionBy(group)
    placed = df.select(group, item, (F.row_number().over(w.orderBy(*order)) - 1).alias("_i"), F.floor(numbers.seeded(seed, F.lit(1)) * F.count("*").over(w)).alias("_j"))
    return placed.where("_i = _j").select(group, item)


def _numbers(seed: int) -> Iterator[float]:
    """The numbers of ``numbers.seeded``, one after the other."""
    mask, a = 0xFFFFFFFF, seed
    while True:
        a = (a + 0x6D2B79F5) & mask
        t = ((a ^ (a >> 15)) * (a | 1)) & mask
        t ^= (t + ((t ^ (t >> 7)) * (t | 61))) & mask
        yield (t ^ (t >> 14)) / 4294967296


def rows_around(df: DataFrame, group: str, order: list[str], item: str, pick: Column, pool: Column, seed: Column, size: int) -> DataFrame:
    """(group, item, position): each group's pick amid ``size`` - 1 others at most, drawn from the ``pool`` first and then from all.

    Both draws shuffle their whole list with one stream of numbers, the second one without what the first one took.
    """
    rows = df.select(group, item, pick.alias("_pick"), pool.alias("_pool"), seed.alias("_seed"), F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("_i"))

    def row(keys: list, picks: list[bool], pools: list[bool], seed: int) -> list:
        chosen = picks.index(True)
        draws, taken, rest = _numbers(seed), [], [i for i, p in enumerate(picks) if not p]
        for some in ([i for i in rest if pools[i]], rest):
            gone = {keys[i] for i in taken}
            left = [i for i in some if keys[i] not in gone]
            places = [0] * len(left)
            for i in range(len(left) - 1, 0, -1):
                places[i] = int(next(draws) * (i + 1))
            taken += [left[i] for i in exchanged(places)][: size - 1 - len(taken)]
        middle = len(taken) // 2
        return [*taken[:middle], chosen, *taken[middle:]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, first in whole_groups(parts, 1):
            keys, picks, pools, seeds = (part[c].tolist() for c in (item, "_pick", "_pool", "_seed"))
            at, position = [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                if True in picks[a:b]:
                    found = row(keys[a:b], picks[a:b], pools[a:b], int(seeds[a]))
                    at += [a + i for i in found]
                    position += range(len(found))
            yield part.iloc[at][[group, item]].assign(position=np.array(position, np.int32))

    kind = df.schema[group].dataType.simpleString(), df.schema[item].dataType.simpleString()
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_pick", "_pool")})
    return _in_groups(rows, group).mapInPandas(run, f"`{group}` {kind[0]}, `{item}` {kind[1]}, position int")
