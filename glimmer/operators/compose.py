"""What a viewer shows, as tables: layers placed by affine maps, sampled onto one grid and blended
in order; 8-bit colours through tables of 256 entries; another image brought onto a render's grid.

Images are sparse (row, col, value): inside the extent of a layer a pixel without a row counts as
``background``.  A composite has a row for each pixel that a layer reaches; the others are black.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Colour = tuple[float, float, float]
BLENDINGS = ("additive", "translucent", "minimum", "opaque")


@dataclass
class Layer:
    """An image and how it is shown.

    ``linear`` and ``offset`` take (row, col) of a pixel's centre to the world.  Colours of the
    ramp, evenly spaced from the lower to the upper contrast limit, are mixed linearly between.
    """

    image: DataFrame
    height: int
    width: int
    limits: tuple[float, float]
    ramp: list[Colour] = field(default_factory=lambda: [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)])
    linear: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (0.0, 1.0))
    offset: tuple[float, float] = (0.0, 0.0)
    gamma: float = 1.0
    opacity: float = 1.0
    blending: str = "translucent"
    smooth: bool = False
    background: float = 0.0

    def pixel(self) -> float:
        """World units of a pixel's side."""
        return float(abs(np.linalg.det(np.array(self.linear))) ** 0.5)

    def box(self) -> tuple[float, float, float, float]:
        """(y0, x0, y1, x1) that the pixels cover in the world."""
        corners = np.array([(y, x) for y in (0, self.height - 1) for x in (0, self.width - 1)], float) @ np.array(self.linear).T + self.offset
        half = self.pixel() / 2
        return (*(corners.min(0) - half), *(corners.max(0) + half))


def layers_box(layers: list[Layer]) -> tuple[float, float, float, float]:
    boxes = np.array([layer.box() for layer in layers])
    return (*boxes[:, :2].min(0), *boxes[:, 2:].max(0))


def _grid(spark: SparkSession, box: tuple[float, float, float, float], h: int, w: int, pixel: float) -> DataFrame:
    g = spark.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("row"), (F.col("id") % w).cast("int").alias("col"))
    return g.withColumn("wy", box[0] + (F.col("row") + 0.5) * pixel).withColumn("wx", box[1] + (F.col("col") + 0.5) * pixel)


def sampled(layer: Layer, grid: DataFrame) -> DataFrame:
    """(row, col, value) of the grid's pixels inside a layer, by an equi-join on the layer's pixels:
    the nearest one, or the four about the place and their weights."""
    (a, b), (c, d) = np.linalg.inv(np.array(layer.linear)).tolist()
    y, x = F.col("wy") - layer.offset[0], F.col("wx") - layer.offset[1]
    at = grid.select("row", "col", (y * a + x * b).alias("y"), (y * c + x * d).alias("x"))
    at = at.filter(F.col("y").between(0, layer.height - 1) & F.col("x").between(0, layer.width - 1))
    source = layer.image.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").cast("double").alias("value"))
    value = F.coalesce("value", F.lit(layer.background))
    if not layer.smooth:
        near = at.select("row", "col", F.floor(F.col("y") + 0.5).cast("int").alias("r"), F.floor(F.col("x") + 0.5).cast("int").alias("c"))
        return near.join(source, ["r", "c"], "left").select("row", "col", value.alias("value"))
    ty, tx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    about = [F.struct((F.floor("y") + i).cast("int").alias("r"), (F.floor("x") + j).cast("int").alias("c"), ((ty if i else 1 - ty) * (tx if j else 1 - tx)).alias("share")) for i in (0, 1) for j in (0, 1)]
    corners = at.select("row", "col", F.inline(F.array(*about))).filter("share > 0")
    return corners.join(source, ["r", "c"], "left").groupBy("row", "col").agg(F.sum(value * F.col("share")).alias("value"))


def _mixed(v: Column, ramp: list[Colour], channel: int) -> Column:
    """The colour at a place 0..1 of a ramp."""
    if len(ramp) == 1:
        return F.lit(float(ramp[0][channel]))
    stops = [float(c[channel]) for c in ramp]
    n = len(stops) - 1
    k = F.least(F.floor(v * n), F.lit(n - 1)).cast("int")
    low, high = (F.element_at(F.array(*map(F.lit, part)), k + 1) for part in (stops[:-1], stops[1:]))
    return low + (high - low) * (v * n - k)


def composite(layers: list[Layer], box: tuple[float, float, float, float] | None = None, pixel: float | None = None, most: int = 40_000_000) -> tuple[DataFrame, float]:
    """(row, col, r, g, b in 0..1) of the layers from the lowest to the highest, and the pixel size:
    that of the finest layer, or coarser if the image would have more than ``most`` pixels."""
    layers = [layer for layer in layers if layer.opacity > 0]
    if not layers:
        raise ValueError("no layer to show")
    if wrong := [layer.blending for layer in layers if layer.blending not in BLENDINGS]:
        raise ValueError(f"unknown blending {wrong[0]}")
    box = box or layers_box(layers)
    pixel = pixel or min(layer.pixel() for layer in layers)
    sides = lambda p: [max(1, round((box[k + 2] - box[k]) / p)) for k in (0, 1)]
    h, w = sides(pixel)
    if h * w > most:
        pixel *= (h * w / most) ** 0.5
        h, w = sides(pixel)
    grid = _grid(layers[0].image.sparkSession, box, h, w, pixel)
    rows = None
    for i, layer in enumerate(layers):
        one = sampled(layer, grid).filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("layer", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    out = rows.groupBy("row", "col").agg(*[F.max(F.when(F.col("layer") == i, F.col("value"))).alias(f"v{i}") for i in range(len(layers))])
    out = out.withColumns({c: F.lit(0.0) for c in "rgb"})
    for i, layer in enumerate(layers):
        low, high = layer.limits
        place = F.least(F.greatest((F.col(f"v{i}") - low) / ((high - low) or 1.0), F.lit(0.0)), F.lit(1.0))
        place = F.pow(place, F.lit(layer.gamma)) if layer.gamma != 1 else place
        out = out.withColumn(f"v{i}", F.when(F.col(f"v{i}").isNotNull(), place))
        shown = {}
        for k, c in enumerate("rgb"):
            colour, below, a = _mixed(F.col(f"v{i}"), layer.ramp, k), F.col(c), layer.opacity
            now = {"additive": below + colour * a, "minimum": F.least(below, colour), "opaque": colour, "translucent": below * (1 - a) + colour * a}[layer.blending]
            shown[c] = F.when(F.col(f"v{i}").isNotNull(), now).otherwise(below)
        out = out.withColumns(shown)
    return out.select("row", "col", *[F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)).alias(c) for c in "rgb"]), pixel


def ramp_table(colours: list[Colour]) -> list[tuple[int, int, int]]:
    """256 entries of 8 bits through evenly spaced colours; one colour is a ramp from black to it."""
    stops = np.array([(0.0, 0.0, 0.0), *colours] if len(colours) == 1 else colours, float)
    at = np.linspace(0, len(stops) - 1, 256)
    return [tuple(int(v) for v in row) for row in np.clip(np.stack([np.interp(at, np.arange(len(stops)), stops[:, k]) for k in range(3)], 1) * 255 + 1e-9, 0, 255)]


def colourised(image: DataFrame, low: float, high: float, colours: list[Colour]) -> DataFrame:
    """(…, row, col, r, g, b in 0..255): one range for the whole image or movie, through the table."""
    table = ramp_table(colours)
    k = F.least(F.greatest(F.floor((F.col("value") - low) * (255.0 / (high - low))), F.lit(0)), F.lit(255)).cast("int") if high > low else F.lit(0)
    looked = {c: F.element_at(F.array(*[F.lit(entry[i]) for entry in table]), k + 1) for i, c in enumerate("rgb")}
    return image.withColumns(looked).drop("value")


def resampled(source: DataFrame, source_shape: tuple[int, int], shape: tuple[int, int], over: int, origin: tuple[float, float] = (-0.5, -0.5), scale: tuple[float, float] = (1.0, 1.0), translate: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """A source image (row, col, value) on the grid of a render of ``shape`` camera pixels: each
    pixel is the nearest of the source, beyond its edge the one on the edge.

    The axes are apart from each other, so each is an equi-join with a table of one row for each
    output row or column, and the pixels are not shuffled.
    """
    spark, out = source.sparkSession, source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    for name, key, k in (("row", "_r", 0), ("col", "_c", 1)):
        world = origin[k] + (F.col("id") + 0.5) / over
        index = F.least(F.greatest(F.bround((world - translate[k]) / scale[k]), F.lit(0)), F.lit(source_shape[k] - 1)).cast("int")
        axis = spark.range(shape[k] * over).select(F.col("id").cast("int").alias(name), index.alias(key))
        out = out.join(F.broadcast(axis), key)  # a row for each row, or column, of the image
    return out.select("row", "col", "value")


def layer_transform(over: int, origin: tuple[float, float] = (-0.5, -0.5), scale: tuple[float, float] = (1.0, 1.0), translate: tuple[float, float] = (0.0, 0.0)) -> tuple[tuple[float, float], tuple[float, float]]:
    """(scale, translate) that put a render on top of its source image: pixel centres included."""
    return tuple(s / over for s in scale), tuple(t + s * (o + 0.5 / over) for t, s, o in zip(translate, scale, origin, strict=True))


def box_range(box: tuple[float, float, float, float], shape: tuple[int, int], over: int, origin: tuple[float, float] = (-0.5, -0.5)) -> tuple[int, int, int, int]:
    """(top, bottom, left, right) of a box (y0, x0, y1, x1) in camera pixels on the render's grid:
    inside the image, with a row and a column at least."""
    out = []
    for k in (0, 1):
        n = shape[k] * over
        low, high = sorted(((box[k] - origin[k]) * over, (box[k + 2] - origin[k]) * over))
        start = min(max(int(np.floor(low)), 0), n - 1)
        out += [start, min(max(int(np.ceil(high)), start + 1), n)]
    return tuple(out)
