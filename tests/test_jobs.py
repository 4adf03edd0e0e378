"""The queue as a log: batch, stream and a plain walk agree; locks go stale by event time."""

import pytest
from pyspark.sql import functions as F

from vellum.storage import table
from vellum.streaming import jobs

DATA = "/root/testdata/sf0.001"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = ["ask", "claim", "ensure", "fail", "claim", "beat", "done", "claim"]


@pytest.fixture(scope="module")
def events(spark):
    """Events of each user as events of the user's queue."""
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.pmod(F.xxhash64("event_id"), F.lit(len(KINDS))).cast("int"))
    return table(spark, DATA, "events").select(F.concat(F.lit("u"), "user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))


def walk(rows, horizon, stale, most):
    """Jobs as records that change, event after event."""
    log = []
    for key in {r[0] for r in rows}:
        job, later = None, None

        def say(at, key=key):
            log.append((key, job["id"], at, job["status"], job["tries"], job["due"]))

        def end(at, status):
            nonlocal job, later
            job["status"] = status
            say(at)
            job = None
            if later:
                job, later = {"id": later[0], "status": "queued", "tries": 0, "due": later[1]}, None
                say(at)

        def age(now):
            if job and job["status"] == "running" and job["lock"] + stale <= now:
                at = job["lock"] + stale
                if job["tries"] >= most:
                    end(at, "failed")
                else:
                    job.update(status="queued", due=at)
                    say(at)

        for _, i, at, kind in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            age(at)
            state = job["status"] if job else None
            if state is None and kind in ("ask", "ensure"):
                job = {"id": i, "status": "queued", "tries": 0, "due": at}
                say(at)
            elif state == "queued" and kind == "ensure" and job["due"] > at:
                job["due"] = at
                say(at)
            elif state == "queued" and kind == "claim" and job["due"] <= at:
                job.update(status="running", tries=job["tries"] + 1, lock=at)
                say(at)
            elif state == "running" and kind == "ensure":
                later = later or (i, at)
            elif state == "running" and kind == "beat":
                job["lock"] = at
            elif state == "running" and kind == "done":
                end(at, "done")
            elif state == "running" and kind == "fail":
                if job["tries"] >= most:
                    end(at, "failed")
                else:
                    job.update(status="queued", due=at + min(21600, 30 * 4 ** (job["tries"] - 1)))
                    say(at)
        age(horizon)
    return sorted(log)


def rows_of(df):
    return sorted((r.key, r.job, round(r.at, 6), r.status, r.attempts, round(r.run_at, 6)) for r in df.collect())


def rounded(log):
    return [(k, j, round(a, 6), s, n, round(d, 6)) for k, j, a, s, n, d in log]


@pytest.mark.parametrize(("stale", "most"), [(1800.0, 3), (86400.0, 2)])
def test_batch(spark, events, stale, most):
    rows = [(r.key, r.id, r.at, r.kind) for r in events.select("key", "id", F.col("ts").cast("double").alias("at"), "kind").collect()]
    horizon = max(r[2] for r in rows) - 3600
    want = rounded(walk(rows, horizon, stale, most))
    assert rows_of(jobs.logged(events.withColumn("at", F.col("ts").cast("double")), horizon, stale, most)) == want
    assert {s for *_, s, _, _ in want} >= {"queued", "running", "failed"}
    assert jobs.logged(events.where("false").withColumn("at", F.lit(0.0)), 0.0).count() == 0


def test_stream(spark, events, tmp_path):
    """One file a batch, in the order of time; the last batches only move the watermark and fire timers."""
    marks = events.select(F.percentile_approx(F.col("ts").cast("double"), [0.25, 0.5, 0.75])).first()[0]
    part = F.lit(0)
    for m in marks:
        part += (F.col("ts").cast("double") > m).cast("int")
    for i in range(4):
        events.where(part == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        log = jobs.logged_stream(source, "1 hour")
        run = log.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
        run.processAllAvailable()
        run.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = events.agg(F.max(F.col("ts").cast("double"))).first()[0]
    got, want = rows_of(spark.read.parquet(str(tmp_path / "out"))), rows_of(jobs.logged(events.withColumn("at", F.col("ts").cast("double")), last - 3600))
    assert got == want, (sorted(set(want) - set(got)), sorted(set(got) - set(want)), last)
