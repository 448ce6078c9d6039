"""Choices around the tables: camera maps, settings, pending bounds, names, cached links, tooltips."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.operators.filters import Bounds
from glimmer.operators.link import link

# Older names of settings, what they are now and the factor between them.
_OLDER = {"min_distance_nm": ("distance_um", 1e-3), "gain_photon": ("gain_electron", 1.0), "frame_one_indexed": ("frame_shift", -1.0)}
#: Settings that belong to the instrument; only a session that was opened by hand restores them.
INSTRUMENT = ("pixel_size_nm", "gain_electron", "camera_offset", "frame_interval_ms")


def camera_map(record: dict, calibrated: dict | None) -> tuple[list[float] | None, str]:
    """(matrix, why): the record's own map, else a calibrated one of the same orientation and
    frame or an integer binning of it, else none with the reason."""
    if record.get("camera_map"):
        return record["camera_map"], "the record's own map"
    if not calibrated:
        return None, "no calibrated map"
    if record.get("orientation") != calibrated.get("orientation"):
        return None, "another orientation"
    a, b = record.get("frame_px"), calibrated.get("frame_px")
    if a == b:
        return calibrated["matrix"], "the calibrated map"
    if a and b and b % a == 0:
        return [v * a / b for v in calibrated["matrix"]], f"the calibrated map, binned by {b // a}"
    return None, "another frame size"


def settings_from(metadata: dict, by_hand: bool) -> tuple[dict, list[str]]:
    """Parameters of a saved run in today's names, and what was translated or left alone."""
    out, notes = {}, []
    for section in metadata.values():
        for k, v in (section.items() if isinstance(section, dict) else ()):
            if k in _OLDER:
                name, factor = _OLDER[k]
                out[name] = v * factor
                notes.append(f"{k} is now {name}")
            elif k in INSTRUMENT and not by_hand:
                notes.append(f"{k} was kept as it is set")
            else:
                out[k] = v
    return out, notes


def resolved(bounds: Bounds, df: DataFrame | None) -> tuple[Bounds, list[str]]:
    """Bounds that apply to a table, and the names that wait for a column; all wait without one."""
    if df is None:
        return {}, sorted(bounds)
    return {k: v for k, v in bounds.items() if k in df.columns}, sorted(k for k in bounds if k not in df.columns)


def previous_run(names: list[str]) -> str | None:
    """The latest dated run folder, else the highest of the older numbered ones."""
    dated = sorted(n for n in names if n[:4].isdigit() and "_" in n)
    if dated:
        return dated[-1]
    numbered = [(int(n.split("_")[1]), n) for n in names if n.startswith("analysis_") and n.split("_")[1].isdigit()]
    return max(numbered)[1] if numbered else None


def layer_name(population: str | None = None, merged: bool = False) -> str:
    return "smlm_render" + (f"_{population}" if population else "") + ("_merged" if merged else "")


class LinkCache:
    """Trajectories by what they were linked from; they come back for the same rows and settings.

    The key holds a digest of the rows, whatever their order (two sums over hashes of whole rows,
    one pass without a shuffle of rows), the columns and the settings.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def key(self, points: DataFrame, **settings: object) -> str:
        row = [F.col(f"`{c}`") for c in points.columns]
        one, other = F.xxhash64(*row), F.xxhash64(F.lit("other"), *row)
        digest = points.agg(F.count(F.lit(1)), *[F.sum(h.cast("decimal(20,0)")) for h in (one, other)]).first()
        told = [points.dtypes, [str(v) for v in digest], settings]
        return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()[:24]

    def link(self, points: DataFrame, search: float, memory: int = 0, least: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
        spark = points.sparkSession
        path = os.path.join(self.folder, self.key(points, search=search, memory=memory, least=least, by=by))
        done = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            link(points, search, memory, least, by).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def tooltip(metrics: DataFrame, points: DataFrame, particle: int) -> DataFrame:
    """One row about a trajectory: start, end, span, points and the metrics there are."""
    p = points.filter(F.col("particle") == particle).groupBy("particle").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), (F.max("frame") - F.min("frame") + 1).alias("span"), F.count(F.lit(1)).alias("points"))
    return p.join(metrics.filter(F.col("particle") == particle).drop("n"), "particle", "left")


def attach_population(table: DataFrame, posteriors: DataFrame) -> DataFrame:
    """Posterior columns by particle; rows outside every trajectory have none."""
    cols = [c for c in posteriors.columns if c.startswith("p_")]
    return table.join(posteriors.select("particle", *cols), "particle", "left")


def soft_weights(table: DataFrame, population: str) -> Column:
    return F.coalesce(F.col(population), F.lit(0.0))


def render_table(locs: DataFrame, merged: DataFrame) -> DataFrame:
    """Merged rows in place of the originals; a merged row counts for all it was made of."""
    rest = locs.join(merged.filter("n_merged > 1").select("particle"), "particle", "left_anti")
    return rest.withColumn("weight", F.lit(1.0)).unionByName(merged.filter("n_merged > 1").withColumn("weight", F.col("n_merged").cast("double")), allowMissingColumns=True)
