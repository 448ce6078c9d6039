"""Growth maps between first, final and local geometry, as column expressions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.functions import scalars


@dataclass(frozen=True)
class QuadMap:
    """Position map of six quadratic terms of the normalised position."""

    coef: list[tuple[float, float]]
    center: tuple[float, float]
    scale: float

    def at(self, x: Column, y: Column) -> tuple[Column, Column]:
        return scalars.quad_map(x, y, self.coef, self.center, self.scale)

    def jacobian(self, x: Column, y: Column) -> list[Column]:
        return scalars.quad_jacobian(x, y, self.coef, self.center, self.scale)

    def back(self, x: Column, y: Column, rounds: int = 6) -> tuple[Column, Column]:
        """The position that the map takes to (x, y): Newton steps from the way back of its linear
        part, folded over a fixed number of rounds."""
        (ox, oy), (a, c), (b, d) = self.coef[:3]
        det = a * d - b * c
        u, v = (d * (x - ox) - b * (y - oy)) / det, (a * (y - oy) - c * (x - ox)) / det
        start = F.struct((u * self.scale + self.center[0]).alias("x"), (v * self.scale + self.center[1]).alias("y"))

        def step(p: Column, _: Column) -> Column:
            at, (xx, xy, yx, yy) = self.at(p["x"], p["y"]), self.jacobian(p["x"], p["y"])
            dx, dy, size = x - at[0], y - at[1], xx * yy - xy * yx
            return F.struct((p["x"] + (yy * dx - xy * dy) / size).alias("x"), (p["y"] + (xx * dy - yx * dx) / size).alias("y"))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
        return found["x"], found["y"]


def identity(center: tuple[float, float], scale: float) -> QuadMap:
    return QuadMap([center, (scale, 0.0), (0.0, scale), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)], center, scale)


def to_white_light(x: Column, y: Column, m: tuple[float, float, float, float], t: tuple[float, float]) -> tuple[Column, Column]:
    """Fluorescence position to white light: M p + T."""
    u, v = scalars.matrix_map(x, y, m)
    return u + t[0], v + t[1]


def to_fluorescence(x: Column, y: Column, m: tuple[float, float, float, float], t: tuple[float, float]) -> tuple[Column, Column]:
    a, b, c, d = m
    det = a * d - b * c
    return scalars.matrix_map(x - t[0], y - t[1], (d / det, -b / det, -c / det, a / det))


def final_position(x: Column, y: Column, growth: QuadMap, m=(1.0, 0.0, 0.0, 1.0), t=(0.0, 0.0)) -> tuple[Column, Column]:
    """Where a position would be in the final geometry: through white light and the growth map."""
    return to_fluorescence(*growth.at(*to_white_light(x, y, m, t)), m, t)


def first_position(x: Column, y: Column, growth: QuadMap, m=(1.0, 0.0, 0.0, 1.0), t=(0.0, 0.0)) -> tuple[Column, Column]:
    """The way back of ``final_position``."""
    return to_fluorescence(*growth.back(*to_white_light(x, y, m, t)), m, t)


def local_position(fx: Column, fy: Column, jacobian: list[Column], cx: Column, cy: Column) -> tuple[Column, Column]:
    """Final positions taken back to local lengths about a centre: J^-1 (f - c) + c.

    Diffusion, distance and the static test use these, linking and rendering the final ones.
    """
    xx, xy, yx, yy = jacobian
    det = F.nullif(xx * yy - xy * yx, F.lit(0.0))
    dx, dy = fx - cx, fy - cy
    return (yy * dx - xy * dy) / det + cx, (xx * dy - yx * dx) / det + cy


def mapped_rows(points: DataFrame, growth: QuadMap) -> DataFrame:
    """Points (particle, frame, x, y) with their final and local positions; the centre of a
    trajectory is the mean of its points."""
    from pyspark.sql import Window

    w = Window.partitionBy("particle")
    fx, fy = growth.at(F.col("x"), F.col("y"))
    p = points.withColumn("x_final", fx).withColumn("y_final", fy)
    for c in ("x", "y", "x_final", "y_final"):
        p = p.withColumn(f"_{c}", F.avg(c).over(w))
    lx, ly = local_position(F.col("x_final"), F.col("y_final"), growth.jacobian(F.col("_x"), F.col("_y")), F.col("_x_final"), F.col("_y_final"))
    return p.withColumn("x_local", lx).withColumn("y_local", ly).drop("_x", "_y", "_x_final", "_y_final")


def map_table(spark: SparkSession, maps: list[QuadMap]) -> DataFrame:
    """A row for each frame: frame, the 12 numbers of its map, its centre and scale."""
    rows = [(k, [float(v) for pair in m.coef for v in pair], float(m.center[0]), float(m.center[1]), float(m.scale)) for k, m in enumerate(maps)]
    return spark.createDataFrame(rows, "frame int, coef array<double>, cx double, cy double, scale double")


def save_record(path: str, times: list[float], maps: list[QuadMap], stats: dict) -> None:
    with open(path, "w") as f:
        json.dump({"kind": "growth", "t_epoch": times, "forward": [asdict(m) for m in maps], "stats": stats}, f)


def load_record(path: str) -> tuple[list[float], list[QuadMap], dict]:
    with open(path) as f:
        d = json.load(f)
    if d.get("kind") != "growth":
        raise ValueError(f"{path} is not a growth record")
    return d["t_epoch"], [QuadMap([tuple(c) for c in m["coef"]], tuple(m["center"]), m["scale"]) for m in d["forward"]], d.get("stats", {})


def map_at(times: list[float], maps: list[QuadMap], t: float) -> QuadMap:
    """Coefficients interpolated in time; the edge map is held."""
    if t <= times[0]:
        return maps[0]
    for (a, b), (m, n) in zip(zip(times, times[1:], strict=False), zip(maps, maps[1:], strict=False), strict=False):
        if t <= b:
            w = (t - a) / (b - a)
            return QuadMap([(p[0] * (1 - w) + q[0] * w, p[1] * (1 - w) + q[1] * w) for p, q in zip(m.coef, n.coef, strict=True)], m.center, m.scale)
    return maps[-1]
