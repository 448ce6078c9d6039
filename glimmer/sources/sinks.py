"""Sinks: run folders, table sets, sparse renders, sessions."""

from __future__ import annotations

import json
import os
import struct
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_folder(base: str, kind: str, now: datetime | None = None) -> str:
    """A new folder ``analysis/<stamp>_<kind>``; two in one second get different names."""
    stamp = (now or datetime.now()).strftime("%Y-%m-%d_%H%M%S")
    for k in range(1000):
        path = os.path.join(base, "analysis", f"{stamp}_{kind}" + (f"_{k + 1}" if k else ""))
        try:
            os.makedirs(path)
            return path
        except FileExistsError:
            continue
    raise FileExistsError(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, even for an empty table; nothing is left of a failed write."""
    names = df.columns
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)
    if df.isEmpty() and os.path.isdir(path):
        with open(os.path.join(path, "part-00000-empty.csv"), "w") as f:
            f.write(",".join(names) + "\n")


def export(folder: str, tables: dict[str, DataFrame], metadata: dict) -> None:
    """Named tables as CSV under ``data``, then their metadata."""
    for name, df in tables.items():
        write_csv(df, os.path.join(folder, "data", f"{name}.csv"))
    with open(os.path.join(folder, "metadata.json"), "w") as f:
        json.dump(metadata, f, default=str, indent=1)


def dense(image: DataFrame, height: int, width: int) -> np.ndarray:
    """A sparse image as an array; for sinks only."""
    out = np.zeros((height, width), np.float32)
    for f in image.select("row", "col", "value").toLocalIterator():
        out[f["row"], f["col"]] = f["value"]
    return out


def tiff_bytes(image: np.ndarray) -> bytes:
    """An uncompressed float32 grey TIFF of one page."""
    data = image.astype("<f4").tobytes()
    tags = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, image.shape[0]), (279, 4, len(data)), (339, 3, 3)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0\0\0\0"
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + ifd


def save_render(path: str, image: DataFrame, height: int, width: int, metadata: dict) -> None:
    with open(path, "wb") as f:
        f.write(tiff_bytes(dense(image, height, width)))
    with open(path + ".json", "w") as f:
        json.dump(metadata, f, default=str)


def projection(movie: DataFrame, colour: bool = False) -> DataFrame:
    """A movie over time: the sum of data, the maximum of colours."""
    return movie.groupBy("row", "col").agg((F.max if colour else F.sum)("value").alias("value"))
