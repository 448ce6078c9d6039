"""Streams over growing folders: cumulative windows, clock, versions of settings, progress and cancelling."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glimmer.streaming import windows as W


@pytest.fixture()
def source(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(k: int, first: int, last: int) -> None:
        n = np.arange(first, last)
        pd.DataFrame({"acquisition": np.int64(1), "loc": n, "frame": n, "x": n * 0.1, "y": 0.0, "photons": 1.0 + n % 3}).to_parquet(folder / f"{k}.parquet")

    def stream(**options):
        return spark.readStream.schema("acquisition long, loc long, frame long, x double, y double, photons double").options(**options).parquet(str(folder))

    put.stream = stream
    return put


def done(q):
    q.awaitTermination()


def test_cumulative_windows(spark, source, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    total = lambda n: sum(1.0 + k % 3 for k in range(n))
    source(0, 0, 30)
    for k, (n, more) in enumerate([(30, (30, 55)), (55, (100, 103)), (58, None)]):
        done(W.start_cumulative(W.event_time(source.stream()), 10, out, checkpoint, availableNow=True))
        rows = spark.read.parquet(out).orderBy("start").collect()
        assert rows[-1].n == n and [r.n for r in rows][:3] == [10, 20, 30] and [r.photons for r in rows][:3] == [total(10), total(20), total(30)]
        if more:
            source(k + 1, *more)
    assert len(rows) == 7  # windows without rows have none


def test_clock(spark, source):
    source(0, 0, 40)
    pages = spark.createDataFrame([(k, 100.0 + 0.5 * k + 0.01) for k in range(0, 25, 2)], "page long, t double")
    clock = spark.createDataFrame([(0.5, 100.0)], "slope double, intercept double")
    q = W.clocked(source.stream(), pages, clock).writeStream.format("memory").queryName("clocked").trigger(availableNow=True).start()
    done(q)
    got = {r.frame: (r.t, r.extrapolated) for r in spark.table("clocked").collect()}
    assert got[10] == (pytest.approx(105.01), False) and got[11] == (105.5, True) and got[39] == (119.5, True) and len(got) == 40


def link(source, tmp_path, search, **kw):
    q = W.live_linker(source.stream(), search, 1, **kw).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    done(q)


def test_settings_are_part_of_the_state(spark, source, tmp_path):
    source(0, 0, 10)
    link(source, tmp_path, 1.0)
    source(1, 10, 20)
    link(source, tmp_path, 1.0)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("particle").distinct().count() == 1 and out.select("version").distinct().count() == 1
    source(2, 20, 30)
    link(source, tmp_path, 0.05)  # another range: nothing of the old state is used
    out = spark.read.parquet(str(tmp_path / "out"))
    versions = {r.version: (r.n, r.first) for r in out.groupBy("version").agg(F.countDistinct("particle").alias("n"), F.min("frame").alias("first")).collect()}
    assert sorted(versions.values()) == [(1, 0), (10, 20)]
    source(3, 30, 40)
    link(source, tmp_path, 1.0)  # back again: the first state is too old to go on from by its memory
    out = spark.read.parquet(str(tmp_path / "out")).filter("frame >= 30")
    assert out.select("particle").distinct().count() == 1 and out.agg(F.min("particle")).first()[0] == 30
    assert W.fingerprint({"a": 1, "b": 2}) == W.fingerprint({"b": 2, "a": 1}) != W.fingerprint({"a": 1, "b": 3})


def wait_for(what, seconds=40):
    end = time.time() + seconds
    while not what() and time.time() < end:
        time.sleep(0.3)
    assert what()


def test_idle_state_is_dropped(spark, source):
    source(0, 0, 10)
    q = W.live_linker(source.stream(), 1.0, 1, idle_s=1.0).writeStream.format("memory").queryName("idle").start()
    states = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    try:
        wait_for(lambda: spark.table("idle").count() == 10)
        wait_for(lambda: states() and max(states()) == 1 and states()[-1] == 0)
        source(1, 10, 12)
        wait_for(lambda: spark.table("idle").count() == 12)
    finally:
        q.stop()
    assert sorted({r.particle for r in spark.table("idle").collect()}) == [0, 10]


def test_progress_and_cancelling(spark, source, tmp_path):
    for k in range(6):
        source(k, 10 * k, 10 * k + 10)
    out, seen, wanted = str(tmp_path / "out"), [], [False]

    def slow(batch, k):
        batch.write.mode("overwrite").parquet(f"{out}/batch={k}")
        time.sleep(0.6)

    def start():
        return source.stream(maxFilesPerTrigger=1).writeStream.queryName("watched").foreachBatch(slow).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()

    def report(rows, batch):
        seen.append((rows, batch))
        wanted[0] = len(seen) >= 2

    assert W.watched(spark, start, report, lambda: wanted[0]) is False
    assert 2 <= len(seen) < 6 and seen[0] == (10, 0) and seen[1] == (20, 1)
    assert W.watched(spark, start, lambda *a: None, lambda: False) is True
    assert sorted(r.loc for r in spark.read.parquet(out).collect()) == list(range(60))
