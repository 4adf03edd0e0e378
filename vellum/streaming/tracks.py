"""Tracks of boundaries across frames: which point of a frame continues which track, with state that outlives gaps.

A chain (a shelf in a recording) sees points in frame after frame.  A point continues the track
nearest to it, within a tolerance, if the track was seen at most ``GAP`` frames ago; points and
tracks pair one to one, nearest first; a track then lies halfway between its old place and the
point.  ``tracked`` is the batch form, ``tracked_stream`` the same with state in Spark's store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

# Frames that a track may be missed, support that it needs, the score of a point seen once,
# the share of the width at each side where nothing can be seen for sure.
GAP, SUPPORT, SINGLE, MARGIN = 3, 0.45, 1.3, 0.03
POINTS = "chain long, frame int, id long, x double, tolerance double"
TRACKED = "chain long, frame int, id long, track int, place double"

Track = tuple[int, float, int]  # number, place, last frame


def step(tracks: list[Track], born: int, frame: int, points: list[tuple[int, float, float]], gap: int = GAP) -> tuple[list[Track], int, list[tuple[int, int, float]]]:
    """A frame's points (id, x, tolerance) meet the live tracks: the tracks after it, how many were born so far, and (id, track, place) of the points."""
    live = [t for t in tracks if frame - t[2] <= gap]
    pairs = sorted((abs(t[1] - x), j, i) for j, (_, x, tolerance) in enumerate(points) for i, t in enumerate(live) if abs(t[1] - x) <= tolerance)
    of_point: dict[int, int] = {}
    taken = set()
    for _, j, i in pairs:
        if j not in of_point and i not in taken:
            of_point[j] = i
            taken.add(i)
    out = []
    for j, (point, x, _) in enumerate(points):
        if j in of_point:
            number, place, _ = live[of_point[j]]
            live[of_point[j]] = (number, (place + x) / 2, frame)
            out.append((point, number, (place + x) / 2))
        else:
            live.append((born, x, frame))
            out.append((point, born, x))
            born += 1
    return live, born, out


def _frames(rows: pd.DataFrame) -> Iterator[tuple[int, list[tuple[int, float, float]]]]:
    for frame, part in rows.groupby("frame", sort=True):
        part = part.sort_values(["x", "id"])
        yield int(frame), list(zip(part["id"].tolist(), part["x"].tolist(), part["tolerance"].tolist(), strict=True))


def tracked(points: DataFrame, gap: int = GAP) -> DataFrame:
    """(chain, frame, id, track, place) of ``POINTS``: the track that each point begins or continues, and where it lies then.

    A chain's points stream through their task frame by frame; the state is the live tracks.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at, tracks, born, held = None, None, [], 0, []

        def flush() -> list[tuple]:
            nonlocal tracks, born
            if not held:
                return []
            tracks, born, out = step(tracks, born, at, sorted(held, key=lambda p: (p[1], p[0])), gap)
            held.clear()
            return [(now, at, *o) for o in out]

        for part in parts:
            done = []
            for r in part.itertuples(index=False):
                if (r.chain, r.frame) != (now, at):
                    done += flush()
                    if r.chain != now:
                        tracks, born = [], 0
                    now, at = r.chain, r.frame
                held.append((r.id, r.x, r.tolerance))
            yield pd.DataFrame(done, columns=["chain", "frame", "id", "track", "place"])
        yield pd.DataFrame(flush(), columns=["chain", "frame", "id", "track", "place"])

    rows = points.select("chain", "frame", "id", "x", "tolerance").repartition("chain").sortWithinPartitions("chain", "frame", "x", "id")
    return rows.mapInPandas(run, TRACKED)


class _Tracker(StatefulProcessor):
    """State of a chain: its live tracks, and the number born so far.  Frames come in order; those of one batch are sorted."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getListState("tracks", "number int, place double, last int")
        self.born = handle.getValueState("born", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tracks = [tuple(t) for t in self.tracks.get()] if self.tracks.exists() else []
        born = self.born.get()[0] if self.born.exists() else 0
        out = []
        for frame, points in _frames(pd.concat(list(rows))):
            tracks, born, found = step(tracks, born, frame, points, self.gap)
            out += [(key[0], frame, *f) for f in found]
        self.tracks.put([(int(a), float(b), int(c)) for a, b, c in tracks])
        self.born.update((int(born),))
        yield pd.DataFrame(out, columns=["chain", "frame", "id", "track", "place"])

    def close(self) -> None:
        pass


def tracked_stream(points: DataFrame, gap: int = GAP) -> DataFrame:
    """Streaming twin of ``tracked``; needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    rows = points.select("chain", "frame", "id", "x", "tolerance")
    return rows.groupBy("chain").transformWithStateInPandas(_Tracker(gap), StructType.fromDDL(TRACKED), "append", "none")


def supported(found: DataFrame, points: DataFrame, frames: DataFrame, width: Column) -> DataFrame:
    """(chain, track, place, seen, visible, support, position): tracks seen often enough among the frames in which they could be seen, in order along the chain.

    ``points``: (id, score); ``frames``: (chain, frame) with the columns of ``width``; a track lies in sight where it keeps
    ``MARGIN`` of the width to both sides.  A track seen once needs a score of ``SINGLE``, unless the chain has one frame.
    """
    from pyspark.sql.window import Window

    last = F.max_by("place", F.struct("frame", "id"))
    one = found.join(points.select("id", "score"), "id").groupBy("chain", "track").agg(last.alias("place"), F.count("*").alias("seen"), F.median("score").alias("_score"))
    sizes = frames.select("chain", "frame", width.alias("_w"))
    many = sizes.groupBy("chain").agg(F.count("*").alias("_frames"))
    # Widths of a chain are few; tracks meet widths, not frames.  A place on the margin itself (28.8 of 960) is out of sight, whatever
    # the last bit of the product.
    widths = sizes.groupBy("chain", "_w").agg(F.count("*").alias("_n"))
    sight = one.join(widths, "chain").where((F.col("place") > F.round(MARGIN * F.col("_w"), 9)) & (F.col("place") < F.round((1 - MARGIN) * F.col("_w"), 9))).groupBy("chain", "track").agg(F.sum("_n").alias("visible"))
    out = one.join(sight, ["chain", "track"], "left").join(many, "chain").withColumn("visible", F.coalesce("visible", F.lit(0)))
    out = out.withColumn("support", F.col("seen") / F.greatest(F.lit(1), F.col("visible")))
    kept = out.where((F.col("support") >= SUPPORT) & ((F.col("seen") >= 2) | (F.col("_score") >= SINGLE) | (F.col("_frames") == 1)))
    position = F.row_number().over(Window.partitionBy("chain").orderBy("place", "track")) - 1
    return kept.select("chain", "track", "place", "seen", "visible", F.round("support", 9).alias("support"), position.alias("position"))
