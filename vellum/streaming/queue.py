"""A work queue as tables: each step takes the jobs and gives them changed.

Jobs: id, type, key (null: never merged), status (queued, running, done, failed), attempts,
most (attempts), run_at, locked_at, locked_by, error; instants are seconds.  A step is one pass
over the table, by key where requests meet jobs; nothing is locked, since a step's result is
the next table (a batch, or the state of ``foreachBatch``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import numbers

STALE = 1800.0
JOB = "id long, type string, key string, status string, attempts int, most int, run_at double, locked_at double, locked_by string, error string"


def accepted(jobs: DataFrame, requests: DataFrame, queued_only: bool = False) -> DataFrame:
    """The requests (type, key, at, id) that become jobs: of each type and key the first, if no open job bears it; all those without a key."""
    states = ["queued"] if queued_only else ["queued", "running"]
    open_ = jobs.where(F.col("status").isin(states) & F.col("key").isNotNull()).select("type", "key").distinct()
    first = requests.where("key is not null").groupBy("type", "key").agg(F.min(F.struct("at", "id")).alias("_f"))
    keyed = first.join(open_, ["type", "key"], "left_anti").select("type", "key", F.col("_f.at").alias("at"), F.col("_f.id").alias("id"))
    return keyed.unionByName(requests.where("key is null").select("type", "key", "at", "id"))


def ensured(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, type, key, run_at, created) of one queued job for each (type, key, at, id) wanted: the earliest open one, pulled forward to ``at``, or a new one.

    Running jobs do not count, so work under way gets a run to follow.
    """
    ask = wanted.groupBy("type", "key").agg(F.min("at").alias("at"), F.min("id").alias("_new"))
    queued = jobs.where("status = 'queued' and key is not null").groupBy("type", "key").agg(F.min(F.struct("run_at", "id")).alias("_q"))
    both = ask.join(queued, ["type", "key"], "left")
    return both.select(F.coalesce("_q.id", "_new").alias("id"), "type", "key", F.least(F.coalesce("_q.run_at", "at"), "at").alias("run_at"), F.col("_q").isNull().alias("created"))


def claimable(jobs: DataFrame, now: float) -> Column:
    return (F.col("status") == "queued") & (F.col("run_at") <= now)


def claimed(jobs: DataFrame, now: float, workers: list[str]) -> DataFrame:
    """The jobs with the next runnable ones, earliest first, given to ``workers``, one each."""
    order = Window.orderBy("run_at", "id")
    # As many rows as there are workers: a top-k, numbered in one task.
    top = jobs.where(claimable(jobs, now)).orderBy("run_at", "id").limit(len(workers)).select("id", "run_at")
    given = top.select("id", F.get(F.array(*[F.lit(w) for w in workers]), F.row_number().over(order) - 1).alias("_w"))
    out, got = jobs.join(F.broadcast(given), "id", "left"), F.col("_w").isNotNull()
    return _changed(out, jobs, got, status=F.lit("running"), locked_at=F.lit(now), locked_by=F.col("_w"), attempts=F.col("attempts") + 1)


def _changed(df: DataFrame, like: DataFrame, when: Column, **new: Column) -> DataFrame:
    return df.select(*[F.when(when, new[c]).otherwise(F.col(c)).cast(like.schema[c].dataType).alias(c) if c in new else F.col(c) for c in like.columns])


def finished(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs whose id stands in ``ids`` are done."""
    out = jobs.join(ids.select("id", F.lit(True).alias("_d")).distinct(), "id", "left")
    return _changed(out, jobs, F.col("_d").isNotNull(), status=F.lit("done"), locked_at=F.lit(None))


def failed(jobs: DataFrame, failures: DataFrame, now: float, base: int = 30, cap: int = 21600) -> DataFrame:
    """Jobs that failed (id, error, retryable): queued again after a growing wait, or failed for good."""
    one = failures.groupBy("id").agg(F.min("error").alias("_error"), F.min("retryable").alias("_retry"))
    out, hit = jobs.join(one, "id", "left"), F.col("_error").isNotNull()
    over = ~F.col("_retry") | (F.col("attempts") >= F.col("most"))
    wait = F.when(over, F.col("run_at")).otherwise(now + numbers.backoff(F.col("attempts"), base, cap))
    return _changed(out, jobs, hit, status=F.when(over, "failed").otherwise("queued"), run_at=wait, locked_at=F.lit(None), locked_by=F.lit(None), error=F.col("_error"))


def touched(jobs: DataFrame, worker: str, now: float) -> DataFrame:
    """Heartbeat of a worker: its running jobs are locked anew."""
    return _changed(jobs, jobs, (F.col("status") == "running") & F.col("locked_by").eqNullSafe(F.lit(worker)), locked_at=F.lit(now))


def requeued(jobs: DataFrame, worker: str, now: float) -> DataFrame:
    """A worker's running jobs queued again without costing an attempt."""
    mine = (F.col("status") == "running") & F.col("locked_by").eqNullSafe(F.lit(worker))
    return _changed(jobs, jobs, mine, status=F.lit("queued"), attempts=F.greatest(F.col("attempts") - 1, F.lit(0)), run_at=F.lit(now), locked_at=F.lit(None), locked_by=F.lit(None))


def reset_stale(jobs: DataFrame, now: float, after: float = STALE) -> DataFrame:
    """Running jobs whose lock is older than ``after``: queued again, or failed if no attempt is left."""
    stale = (F.col("status") == "running") & (F.col("locked_at").isNull() | (F.col("locked_at") < now - after))
    over = F.col("attempts") >= F.col("most")
    lost = F.when(over, "worker lost while running").otherwise(F.col("error"))
    return _changed(jobs, jobs, stale, status=F.when(over, "failed").otherwise("queued"), error=lost, run_at=F.lit(now), locked_at=F.lit(None), locked_by=F.lit(None))


def purged(jobs: DataFrame, updated: str, now: float, days: int) -> DataFrame:
    """Jobs without those that ended more than ``days`` ago."""
    return jobs.where(~(F.col("status").isin("done", "failed") & (F.col(updated) < now - max(1, days) * 86400.0)))
