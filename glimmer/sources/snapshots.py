"""White-light snapshots of an acquisition: their times, the pages that are there, and a check of
the drift record against them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.operators.drift import smoothed
from glimmer.operators.register import shift
from glimmer.operators.timejoin import interpolated
from glimmer.session import cut
from glimmer.sources.stack import decoded, listed, page_index
from glimmer.sources.tables import csv_with_meta


def snapshot_index(spark: SparkSession, tif: str, times: str) -> DataFrame:
    """Where the pages of the snapshots lie, with ``snapshot`` (their order in the times file) and
    ``t``.  The times file lists a page (and its file, as a full stack goes on in another one) for
    each snapshot; snapshots whose file or page is not there are left out.  No page is decoded."""
    _, listed_times = csv_with_meta(spark, times, required=("t_epoch",))
    names = listed_times.columns
    folder, own = tif.rsplit("/", 1)
    row = F.monotonically_increasing_id()  # one small file: in the order of its lines
    order = listed_times.withColumn("_i", row)
    line = F.row_number().over(Window.orderBy("_i")) - 1
    wanted = order.select(
        line.cast("long").alias("snapshot"), F.col("t_epoch").try_cast("double").alias("t"),
        (F.col("file").cast("string") if "file" in names else F.lit(own)).alias("name"),
        (F.coalesce(F.col("page").try_cast("int"), F.lit(0)) if "page" in names else line.cast("int")).alias("page"),
    )
    files = listed(spark, folder).withColumn("name", F.element_at(F.split("path", "/"), -1))
    there = [r["path"] for r in files.join(wanted.select("name").distinct(), "name", "left_semi").collect()]  # a row per file
    if not there:
        raise ValueError(f"none of the files that {times} lists are there")
    index = page_index(spark, there).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return index.join(wanted, ["name", "page"]).drop("name")


def snapshots(index: DataFrame) -> DataFrame:
    """(snapshot, t, height, width, pixels); only the pages of the index are read."""
    frames = decoded(index.withColumn("frame", F.col("snapshot").cast("int")))
    return frames.withColumnRenamed("frame", "snapshot").join(index.select(F.col("snapshot").cast("int").alias("snapshot"), "t"), "snapshot")


def check_snapshots(images: DataFrame, record: DataFrame, sigma: float, grid: float, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(snapshot, t, record_dx, record_dy, dx, dy, quality): the drift of every snapshot against the
    first, as the record has it and as the images show it.

    Each snapshot is cropped where the record says that the sample went, in whole pixels, and only
    what is left is registered.  ``roi`` is (top, left, height, width).
    """
    first = images.orderBy("t", "snapshot").first()  # one image
    h, w = first["height"], first["width"]
    rh, rw = (min(h, 1024), min(w, 1024)) if roi is None else (min(max(8, roi[2]), h), min(max(8, roi[3]), w))
    top, left = ((h - rh) // 2, (w - rw) // 2) if roi is None else (min(max(0, roi[0]), h - rh), min(max(0, roi[1]), w - rw))
    reference = np.frombuffer(bytes(first["pixels"]), np.float64).reshape(h, w)[top : top + rh, left : left + rw]
    curve = smoothed(record, sigma, grid).select("t", "dx", "dy")
    at = cut(interpolated(images.select("snapshot", "t"), curve, "t", "t", ["dx", "dy"], 64 * grid))
    zero = at.filter(F.col("snapshot") == first["snapshot"]).first()
    moved = at.select("snapshot", (F.col("dx") - zero["dx"]).alias("record_dx"), (F.col("dy") - zero["dy"]).alias("record_dy"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for k, t, pixels, rx, ry in f[["snapshot", "t", "pixels", "record_dx", "record_dy"]].itertuples(index=False):
                y, x = (min(max(0, a + round(r)), n - m) for a, r, n, m in ((top, ry, h, rh), (left, rx, w, rw)))
                dx, dy, quality = shift(reference, np.frombuffer(pixels, np.float64).reshape(h, w)[y : y + rh, x : x + rw])
                yield pd.DataFrame({"snapshot": [k], "t": [t], "record_dx": [rx], "record_dy": [ry], "dx": [x - left + dx], "dy": [y - top + dy], "quality": [quality]})

    return images.join(moved, "snapshot").mapInPandas(run, "snapshot int, t double, record_dx double, record_dy double, dx double, dy double, quality double")
