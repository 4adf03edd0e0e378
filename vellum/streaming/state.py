"""Stateful operators on event streams, each with a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

LIMITED = "key {kind}, id long, at double, hits int, allowed boolean"


def _limited(hits: DataFrame) -> str:
    return LIMITED.format(kind=hits.schema["key"].dataType.simpleString())


def _scan(rows: pd.DataFrame, opened: float, hits: int, window: float, limit: int) -> tuple[pd.DataFrame, float, int]:
    """Fixed windows that open at a key's first hit; the count stands still at limit + 1.  A step a window, not a row."""
    at = rows["at"].to_numpy(float)
    n, i = np.empty(len(at), np.int64), 0
    while i < len(at):
        if hits == 0 or at[i] >= opened + window:
            opened, hits = at[i], 0
        end = max(i + 1, int(np.searchsorted(at, opened + window)))
        n[i:end] = np.minimum(hits + 1 + np.arange(end - i), limit + 1)
        hits, i = int(n[end - 1]), end
    return rows[["key", "id", "at"]].assign(hits=n.astype("int32"), allowed=n <= limit), opened, hits


def limited(hits: DataFrame, window: float, limit: int) -> DataFrame:
    """Batch: (key, id, at) with the hit's number in its window and whether it is allowed.

    A key's hits stream through its task in order; the state is two numbers.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, opened, n = None, 0.0, 0
        for part in parts:
            done = []
            for key, rows in part.groupby("key", sort=False):
                if key != now:
                    now, opened, n = key, 0.0, 0
                out, opened, n = _scan(rows, opened, n, window, limit)
                done.append(out)
            if done:
                yield pd.concat(done)

    return hits.select("key", "id", "at").repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(run, _limited(hits))


def limited_stream(hits: DataFrame, window: float, limit: int) -> DataFrame:
    """Streaming twin: state of (opened, hits) for each key."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(parts)).sort_values(["at", "id"])
        out, opened, n = _scan(rows, opened, n, window, limit)
        state.update((opened, n))
        yield out

    return hits.select("key", "id", "at").groupBy("key").applyInPandasWithState(run, _limited(hits), "opened double, hits int", "append", GroupStateTimeout.NoTimeout)


def enqueued(requests: DataFrame, key: str, at: str, order: str, busy: float) -> DataFrame:
    """Requests that enter a queue: those of a key that none accepted within ``busy`` seconds before blocks."""
    hits = requests.select(F.col(key).alias("key"), F.col(order).alias("id"), F.col(at).alias("at"))
    return limited(hits, busy, 1).where("allowed").select("key", "id", "at")


def retried(attempts: DataFrame, job: str, order: list[str], failed: str, most: int = 3) -> DataFrame:
    """State of each job from its attempts in order: done at the first success, failed for good at failure ``most``, else queued with its wait.

    What a job did after its end is not run: it counts neither as attempt nor as success.
    """
    from vellum.functions.numbers import backoff

    w = Window.partitionBy(job).orderBy(*order)
    placed = attempts.select(job, failed, F.row_number().over(w).alias("_i"), F.sum(F.col(failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_f"))
    one = placed.groupBy(job).agg(F.count("*").alias("_n"), F.min(F.when(~F.col(failed), F.col("_i"))).alias("_s"), F.min(F.when(F.col("_f") >= most, F.col("_i"))).alias("_x"))
    end = F.least("_s", "_x")  # the lesser of those that there are
    status = F.when(F.col("_s") == end, "done").when(F.col("_x") == end, "failed").otherwise("queued")
    return one.select(job, F.coalesce(end, F.col("_n")).alias("attempts"), status.alias("status"), F.when(end.isNull(), backoff(F.col("_n"))).alias("wait"))


def tumbling(events: DataFrame, at: str, length: str, kind: str, late: str | None = None) -> DataFrame:
    """(start, kind, n) by window and ``kind``; give ``late`` for a stream, to set its watermark."""
    df = events.withWatermark(at, late) if late else events
    return df.groupBy(F.window(at, length).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def idle_sessions(events: DataFrame, key: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, end, n) of runs of events without a pause of ``gap``."""
    df = events.withWatermark(at, late) if late else events
    return df.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
