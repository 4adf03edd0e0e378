"""Tracks: batch and stream beside a plain walk."""

import random

import pytest

from vellum.streaming import tracks

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def walk(rows, gap=3):
    """Each chain's frames one after the other, points and tracks paired nearest first."""
    out = {}
    for chain in {r[0] for r in rows}:
        live, born = [], 0
        for frame in sorted({r[1] for r in rows if r[0] == chain}):
            points = sorted((r[3], r[2], r[4]) for r in rows if r[:2] == (chain, frame))
            old = [t for t in live if frame - t["last"] <= gap]
            while True:
                free = [(abs(t["x"] - x), j, k) for j, (x, i, tol) in enumerate(points) if (chain, frame, i) not in out for k, t in enumerate(old) if t["last"] < frame and abs(t["x"] - x) <= tol]
                if not free:
                    break
                _, j, k = min(free)
                old[k].update(x=(old[k]["x"] + points[j][0]) / 2, last=frame)
                out[chain, frame, points[j][1]] = (old[k]["n"], old[k]["x"])
            live = old
            for x, i, _ in points:
                if (chain, frame, i) not in out:
                    live.append({"n": born, "x": x, "last": frame})
                    out[chain, frame, i] = (born, x)
                    born += 1
    return out


@pytest.fixture(scope="module")
def points():
    rng = random.Random(5)
    return [(c, f, c * 1000 + f * 20 + i, 100.0 * i + rng.gauss(0, 12), 20.0) for c in range(4) for f in sorted(rng.sample(range(20), 12)) for i in rng.sample(range(8), 5)]


def test_batch(spark, points):
    got = {(r.chain, r.frame, r.id): (r.track, r.place) for r in tracks.tracked(spark.createDataFrame(points, tracks.POINTS)).collect()}
    want = walk(points)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert tracks.tracked(spark.createDataFrame([], tracks.POINTS)).count() == 0


def test_stream(spark, points, tmp_path):
    """Files of five frames each, one batch a file: state goes from batch to batch."""
    for b in range(4):
        part = [r for r in points if r[1] // 5 == b]
        spark.createDataFrame(part, tracks.POINTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        source = spark.readStream.schema(tracks.POINTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = tracks.tracked_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert run.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.chain, r.frame, r.id): r.track for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {k: n for k, (n, _) in walk(points).items()}


def test_places_on_the_margin(spark):
    """28.8 is three hundredths of 960, though 0.03 * 960 falls short of it: not in sight."""
    from pyspark.sql import functions as F

    found = spark.createDataFrame([(1, 0, 10, 0, 28.8), (1, 1, 11, 0, 28.8), (1, 0, 12, 1, 28.9), (1, 1, 13, 1, 28.9)], "chain long, frame int, id long, track int, place double")
    points = found.select("id", F.lit(2.0).alias("score"))
    frames = found.select("chain", "frame").distinct()
    got = {r.track: r.visible for r in tracks.supported(found, points, frames, F.lit(960)).collect()}
    assert got == {0: 0, 1: 2}
