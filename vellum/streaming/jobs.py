"""A work queue as a stream of events: one job at a time for each key, with locks that go stale by event time.

Events: key, id, at (instant), kind and worker.  ``ask`` queues a job if none of the key is open; ``ensure`` pulls a
queued one forward, or lets one follow the job under way; ``claim`` starts a queued job that is due;
``beat`` keeps its lock; ``done`` and ``fail`` end an attempt, a failed one is queued again after a growing
wait or, after ``most`` attempts, for good.  A job whose lock is ``STALE`` seconds old is queued
again, or fails if no attempt is left: by a timer in the stream, before the next event of its
key or at the horizon in the batch form.  Both give the same log of changes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

# Seconds of a stale lock, attempts of a job, first wait, factor and longest wait after a failure.
STALE, MOST, BASE, FACTOR, LONGEST = 1800.0, 3, 30.0, 4.0, 21600.0
LOG = "key string, job long, at double, status string, attempts int, run_at double"
JOB = "job long, status string, attempts int, run_at double, locked_at double, follow long, follow_at double"

Job = tuple[int, str, int, float, float, int, float]  # as JOB; follow -1: none
Change = tuple[int, float, str, int, float]  # as LOG without the key


def stale_at(job: Job | None, stale: float = STALE) -> float | None:
    return job[4] + stale if job and job[1] == "running" else None


def _ended(job: Job, at: float, status: str) -> tuple[Job | None, list[Change]]:
    """A job that ends, and the one that follows it."""
    number, _, attempts, run_at, _, follow, follow_at = job
    out = [(number, at, status, attempts, run_at)]
    if follow < 0:
        return None, out
    return (follow, "queued", 0, follow_at, 0.0, -1, 0.0), [*out, (follow, at, "queued", 0, follow_at)]


def expired(job: Job | None, now: float, stale: float = STALE, most: int = MOST) -> tuple[Job | None, list[Change]]:
    """What the lock's age does to a job at ``now``."""
    at = stale_at(job, stale)
    if at is None or at > now:
        return job, []
    if job[2] >= most:
        return _ended(job, at, "failed")
    job = (*job[:1], "queued", job[2], at, 0.0, *job[5:])
    return job, [(job[0], at, "queued", job[2], at)]


def step(job: Job | None, number: int, at: float, kind: str, stale: float = STALE, most: int = MOST) -> tuple[Job | None, list[Change]]:
    """An event meets the open job of its key."""
    job, out = expired(job, at, stale, most)
    if kind in ("ask", "ensure") and job is None:
        job = (number, "queued", 0, at, 0.0, -1, 0.0)
        out.append((number, at, "queued", 0, at))
    elif kind == "ensure" and job[1] == "queued" and at < job[3]:
        job = (*job[:3], at, *job[4:])
        out.append((job[0], at, "queued", job[2], at))
    elif kind == "ensure" and job[1] == "running" and job[5] < 0:
        job = (*job[:5], number, at)
    elif kind == "claim" and job and job[1] == "queued" and job[3] <= at:
        job = (job[0], "running", job[2] + 1, job[3], at, *job[5:])
        out.append((job[0], at, "running", job[2], job[3]))
    elif job and job[1] == "running" and kind == "beat":
        job = (*job[:4], at, *job[5:])
    elif job and job[1] == "running" and (kind == "done" or (kind == "fail" and job[2] >= most)):
        job, more = _ended(job, at, "done" if kind == "done" else "failed")
        out += more
    elif job and job[1] == "running" and kind == "fail":
        due = at + min(LONGEST, BASE * FACTOR ** (job[2] - 1))
        job = (job[0], "queued", job[2], due, 0.0, *job[5:])
        out.append((job[0], at, "queued", job[2], due))
    return job, out


def logged(events: DataFrame, horizon: float, stale: float = STALE, most: int = MOST) -> DataFrame:
    """Batch form: ``LOG`` of all events, and of the locks that are stale by ``horizon``.  A key's events stream through their task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, job = None, None
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r.key != now:
                    out += [(now, *c) for c in expired(job, horizon, stale, most)[1]]
                    now, job = r.key, None
                job, found = step(job, r.id, r.at, r.kind, stale, most)
                out += [(now, *c) for c in found]
            yield _frame(out)
        yield _frame([(now, *c) for c in expired(job, horizon, stale, most)[1]])

    return events.select("key", "id", F.col("at").cast("double").alias("at"), "kind").repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(run, LOG)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "job", "at", "status", "attempts", "run_at"])


class _Queue(StatefulProcessor):
    """A key's open job, and the timer of its lock."""

    def __init__(self, stale: float, most: int):
        self.stale, self.most = stale, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)

    def _held(self) -> Job | None:
        return tuple(self.job.get()) if self.job.exists() else None

    def _kept(self, job: Job | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if job is None:
            self.job.clear()
            return
        self.job.update(job)
        if (at := stale_at(job, self.stale)) is not None:
            self.handle.registerTimer(math.ceil(at * 1000))  # timers count milliseconds

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job, out = self._held(), []
        for r in pd.concat(list(rows)).sort_values(["at", "id"]).itertuples(index=False):
            job, found = step(job, int(r.id), float(r.at), r.kind, self.stale, self.most)
            out += [(key[0], *c) for c in found]
        self._kept(job)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job, found = expired(self._held(), expiredTimerInfo.getExpiryTimeInMs() / 1000, self.stale, self.most)
        self._kept(job)
        yield _frame([(key[0], *c) for c in found])

    def close(self) -> None:
        pass


def logged_stream(events: DataFrame, late: str, stale: float = STALE, most: int = MOST) -> DataFrame:
    """Streaming twin of ``logged``; events (key, id, ts, kind) of a key come in order, ``ts`` is a timestamp, ``late`` the watermark's delay."""
    rows = events.withWatermark("ts", late).select("key", "id", "ts", F.col("ts").cast("double").alias("at"), "kind")
    return rows.groupBy("key").transformWithStateInPandas(_Queue(stale, most), StructType.fromDDL(LOG), "append", "eventTime")
