"""Structured Streaming forms of the frame windows, drift and clock lookups, gap closing and
linking; and how a query is watched and stopped."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def event_time(df: DataFrame, frame: str = "frame", interval_s: float = 1.0) -> DataFrame:
    """An event time from the frame number."""
    return df.withColumn("event_time", F.timestamp_seconds(F.col(frame) * interval_s))


def windowed_counts(df: DataFrame, size_s: float, slide_s: float | None = None, late_s: float = 10.0) -> DataFrame:
    """Tumbling or sliding counts and photon sums.  In append mode a window appears once it is
    closed (an incomplete last one never does), in update mode at once."""
    window = F.window("event_time", f"{size_s} seconds", f"{slide_s or size_s} seconds")
    g = df.withWatermark("event_time", f"{late_s} seconds").groupBy(window)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("photons").alias("photons")).select(F.col("window.start").alias("start"), "n", "photons")


def running_totals(blocks: DataFrame) -> DataFrame:
    """(start, n, photons) of windows as sums over all windows up to each: a row per window."""
    upto = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.select("start", F.sum("n").over(upto).alias("n"), F.sum("photons").over(upto).alias("photons"))


def start_cumulative(df: DataFrame, size_s: float, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The cumulative mode: after each micro-batch ``path`` holds the running totals over all windows
    so far, late rows included; the state is one row a window, and the same batch written again
    gives the same table."""
    blocks = df.groupBy(F.window("event_time", f"{size_s} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("photons").alias("photons"))

    def write(batch: DataFrame, _: int) -> None:
        running_totals(batch.select(F.col("w.start").alias("start"), "n", "photons")).write.mode("overwrite").parquet(path)

    return blocks.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def clocked(stream: DataFrame, pages: DataFrame, clock: DataFrame, page: str = "frame") -> DataFrame:
    """Rows with the time ``t`` of their page: the recorded one, else that of the clock's line
    (``slope``, ``intercept``; one row), which goes on past the last record."""
    known = pages.groupBy("page").agg(F.min("t").alias("_t"))
    met = stream.join(known, stream[page] == known["page"], "left").drop("page").crossJoin(F.broadcast(clock.select("slope", "intercept")))
    line = F.col("intercept") + F.col("slope") * F.col(page)
    return met.withColumn("t", F.coalesce("_t", line)).withColumn("extrapolated", F.col("_t").isNull()).drop("_t", "slope", "intercept")


def clamped_drift(stream: DataFrame, series: DataFrame, n: int) -> DataFrame:
    """Stream-static join with per-frame drift; frames off the end are clamped and marked."""
    key = F.least(F.greatest(F.col("frame"), F.lit(0)), F.lit(n - 1))
    rows = stream.withColumn("_k", key).withColumn("outside", F.col("frame") != key)
    return rows.join(series.withColumnRenamed("frame", "_k"), "_k", "left").drop("_k")


def gap_sessions(df: DataFrame, interval_s: float, memory: int, late_s: float = 10.0) -> DataFrame:
    """Visits of a particle: a gap of more than ``memory`` frames begins another."""
    gap = F.session_window("event_time", f"{(memory + 1) * interval_s} seconds")
    g = df.withWatermark("event_time", f"{late_s} seconds").groupBy("particle", gap)
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last")).drop("session_window")


def fingerprint(settings: dict) -> str:
    """A short name of settings, the same for equal ones in any order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:12]


def live_linker(df: DataFrame, search: float, memory: int, idle_s: float | None = None) -> DataFrame:
    """Stateful linking of a stream by acquisition: the state is the live particles with their
    last frame and position; one that waited longer than ``memory`` frames is forgotten.  A
    row of a frame that was already linked is linked by itself and marked late.

    The settings are part of the state's key and of the output: a query that goes on from a
    checkpoint with another range or memory begins anew, and what the old settings linked stays
    told apart.  The state of an acquisition without rows for ``idle_s`` seconds is dropped.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from glimmer.operators.link import link_frames

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        done, ids, frames, xs, ys = state.get if state.exists else (-1, [], [], [], [])
        f = pd.concat(list(batches)).sort_values(["frame", "loc"])
        late = f["frame"] <= done
        new = f[~late]
        live = {p: (k, np.array([x, y])) for p, k, x, y in zip(ids, frames, xs, ys, strict=True)}
        of = link_frames(new["frame"].tolist(), new["loc"].tolist(), new[["x", "y"]].to_numpy(float), search, memory, live)
        end = int(max([done, *new["frame"]]))
        kept = [(int(p), int(k), float(at[0]), float(at[1])) for p, (k, at) in live.items() if end - k <= memory]
        state.update((end, *([row[i] for row in kept] for i in range(4))))
        if idle_s is not None:
            state.setTimeoutDuration(int(idle_s * 1000))
        yield pd.DataFrame({"acquisition": key[0], "version": key[1], "loc": f["loc"], "frame": f["frame"], "particle": [loc if w else of[loc] for loc, w in zip(f["loc"], late, strict=True)], "late": late})

    timeout = GroupStateTimeout.NoTimeout if idle_s is None else GroupStateTimeout.ProcessingTimeTimeout
    version = F.lit(fingerprint({"search": search, "memory": memory})).alias("version")
    return df.select("acquisition", version, "loc", "frame", "x", "y").groupBy("acquisition", "version").applyInPandasWithState(
        run, "acquisition long, version string, loc long, frame long, particle long, late boolean", "done long, ids array<long>, frames array<long>, xs array<double>, ys array<double>", "append", timeout)


class Progress(StreamingQueryListener):
    """Hands (rows so far, batch) of one query to a function after every micro-batch."""

    def __init__(self, name: str, report: Callable[[int, int], None]) -> None:
        self.name, self.report, self.rows = name, report, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name:
            self.rows += event.progress.numInputRows
            self.report(self.rows, event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watched(spark: SparkSession, start: Callable[[], StreamingQuery], report: Callable[[int, int], None], cancelled: Callable[[], bool], poll_s: float = 0.2) -> bool:
    """Start a named query and wait for its end, with progress; whether it came to its end.  One that
    is cancelled stops, and goes on from its checkpoint when it is started again."""
    query = start()
    listener = Progress(query.name, report)
    spark.streams.addListener(listener)
    try:
        while not query.awaitTermination(poll_s):
            if cancelled():
                query.stop()
                return False
        return True
    finally:
        spark.streams.removeListener(listener)
