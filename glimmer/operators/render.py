"""Super-resolution images as sparse tables (row, col, value) and movies (movie_frame, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUNCATE, LEAST_SIGMA, MOST_RADIUS = 3.0, 0.5, 64
#: Pixels of a side of a tile, localizations that are dealt to tiles together, and those of one tile
#: from which on they are drawn where they are.
TILE, TOGETHER, DRAWN = 256, 200_000, 16_384
#: Sides of the blocks whose localizations are added up by one product; the smallest with so many
#: localizations a block is taken.
BLOCKS, FILL = (16, 32, 64, 128), 64


def binned(locs: DataFrame, width: int, height: int, over: int) -> DataFrame:
    """Output row and col of every localization in the field [-0.5, size - 0.5)."""
    fx, fy = (F.col("x") + 0.5) * over, (F.col("y") + 0.5) * over
    out = locs.filter("x IS NOT NULL AND y IS NOT NULL").filter(~F.isnan("x") & ~F.isnan("y"))
    out = out.withColumn("col", F.floor(fx).cast("int")).withColumn("row", F.floor(fy).cast("int"))
    return out.filter((F.col("col") >= 0) & (F.col("col") < width * over) & (F.col("row") >= 0) & (F.col("row") < height * over))


def histogram(locs: DataFrame, width: int, height: int, over: int, weight: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, or sums of a weight, by pixel."""
    value = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    return binned(locs, width, height, over).groupBy(*by, "row", "col").agg(value.alias("value"))


def scatter(locs: DataFrame, width: int, height: int, over: int) -> DataFrame:
    return binned(locs, width, height, over).select("row", "col").distinct().withColumn("value", F.lit(1.0))


def splat(locs: DataFrame, width: int, height: int, over: int, sigma_px: Column, weight: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Every localization as a Gaussian of its own width, cut at three sigma and normalised by
    what is left, so that it adds exactly its weight; what falls outside the field is lost.

    Localizations go to the tiles of the image that they touch, packed by tile, and a task draws
    tile after tile.  Where a task has many of one tile, it draws them itself and hands on the
    pixels, so a crowded tile costs its pixels for each task and not its localizations.
    """
    s = F.least(F.greatest(F.coalesce(F.when(~F.isnan(sigma_px), sigma_px * over), F.lit(LEAST_SIGMA)), F.lit(LEAST_SIGMA)), F.lit(MOST_RADIUS / TRUNCATE))
    rows = locs.filter("x IS NOT NULL AND y IS NOT NULL").filter(~F.isnan("x") & ~F.isnan("y"))
    fx, fy = (F.col("x") + 0.5) * over, (F.col("y") + 0.5) * over
    value = F.lit(1.0) if weight is None else weight.cast("double")
    rows = rows.select(*by, fx.alias("_fx"), fy.alias("_fy"), s.cast("double").alias("_s"), value.alias("_w")).filter("_w IS NOT NULL")
    reach = F.ceil(F.col("_s") * TRUNCATE)
    for at, size in (("_fx", width * over), ("_fy", height * over)):
        rows = rows.filter((F.floor(at) + reach >= 0) & (F.floor(at) - reach < size))
    keys = [rows.schema[c] for c in by]
    shape = (height * over, width * over)
    pixel = [T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("value", T.DoubleType())]
    place = [T.StructField("ty", T.IntegerType()), T.StructField("tx", T.IntegerType())]
    dealt = T.StructType([*keys, *place, T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType())])

    def deal(batches):
        held, n = [], 0
        for rows_in in batches:
            held.append(rows_in)
            n += rows_in.num_rows
            if n >= TOGETHER:
                yield _dealt(pa.Table.from_batches(held), by, shape)
                held, n = [], 0
        if n:
            yield _dealt(pa.Table.from_batches(held), by, shape)

    def draw(batches):
        now, total, first = None, np.zeros((TILE, TILE)), None

        def finished() -> pa.RecordBatch:
            flat = total.reshape(-1)
            found = np.flatnonzero(flat)
            named = [c.take(pa.array(np.zeros(len(found), np.int64))) for c in first]
            places = [(found // TILE + now[-2] * TILE).astype(np.int32), (found % TILE + now[-1] * TILE).astype(np.int32), flat[found]]
            out = pa.RecordBatch.from_arrays([*named, *map(pa.array, places)], [*by, "row", "col", "value"])
            total[:] = 0
            return out

        for batch in batches:
            *named, at, value = batch.columns
            for i, tile in enumerate(zip(*(c.to_pylist() for c in named), strict=True)):
                if tile != now:
                    if now is not None:
                        yield finished()
                    now, first = tile, [c.slice(i, 1) for c in named[: len(by)]]
                if at[i].is_valid:
                    total.reshape(-1)[np.frombuffer(at[i].as_buffer(), np.int32)] += np.frombuffer(value[i].as_buffer(), np.float64)
                else:
                    _drawn(total, *np.frombuffer(value[i].as_buffer(), np.float64).reshape(4, -1), *tile[-2:], shape)
        if now is not None:
            yield finished()

    tiles = rows.mapInArrow(deal, dealt).repartition(*by, "ty", "tx").sortWithinPartitions(*by, "ty", "tx")
    return tiles.mapInArrow(draw, T.StructType([*keys, *pixel]))


def _side(f: np.ndarray, s: np.ndarray, reach: int, low: int, n: int) -> np.ndarray:
    """Normalised kernels of centres f on the pixels low .. low + n - 1, which hold them whole."""
    pixels = low + np.arange(n)
    g = np.exp(-0.5 * ((pixels + 0.5 - f[:, None]) / s[:, None]) ** 2)
    g[np.abs(pixels - np.floor(f)[:, None]) > reach] = 0.0
    return g / g.sum(1, keepdims=True)


def _drawn(total: np.ndarray, fx: np.ndarray, fy: np.ndarray, s: np.ndarray, w: np.ndarray, ty: int, tx: int, shape: tuple[int, int]) -> None:
    """Add the part of localizations that lies in a tile.

    A Gaussian is the product of a column and a row, so the image of the localizations of a block is
    one matrix product of their columns and rows.
    """
    reach = np.ceil(s * TRUNCATE).astype(np.int64)
    for side in BLOCKS:
        blocks = np.stack([reach, np.floor(fy / side).astype(np.int64), np.floor(fx / side).astype(np.int64)])
        order = np.lexsort(blocks[::-1])
        begins = np.flatnonzero(np.append(True, np.any(np.diff(blocks[:, order], axis=1) != 0, axis=0)))
        if len(fx) >= FILL * len(begins):
            break
    y0, x0 = ty * TILE, tx * TILE
    y1, x1 = min(y0 + TILE, shape[0]), min(x0 + TILE, shape[1])
    for i, j in zip(begins, np.append(begins[1:], len(fx)), strict=True):
        some = order[i:j]
        r, row, col = (int(v) for v in blocks[:, some[0]])
        n, top, left = side + 2 * r, row * side - r, col * side - r
        a, b, c, d = max(top, y0), min(top + n, y1), max(left, x0), min(left + n, x1)
        if b > a and d > c:
            columns, rows = _side(fy[some], s[some], r, top, n)[:, a - top : b - top], _side(fx[some], s[some], r, left, n)[:, c - left : d - left]
            total[a - y0 : b - y0, c - x0 : d - x0] += (columns * w[some, None]).T @ rows


def _dealt(table: pa.Table, by: tuple[str, ...], shape: tuple[int, int]) -> pa.RecordBatch:
    """(keys, ty, tx, at, value): localizations (keys, fx, fy, s, w) packed by the tiles they touch,
    with ``at`` null, or the pixels of a tile that was drawn."""
    fx, fy, s, w = columns = [table.column(len(by) + k).to_numpy() for k in range(4)]
    reach = np.ceil(s * TRUNCATE)
    key = np.zeros(len(fx), np.int64)
    for c in range(len(by)):
        code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        key = np.unique(key * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
    tiles = [np.clip(np.floor((f + sign * reach) / TILE), 0, (n - 1) // TILE).astype(np.int64) for f, n in ((fy, shape[0]), (fx, shape[1])) for sign in (-1, 1)]
    y0, y1, x0, x1 = tiles
    each = np.arange(len(fx))
    touched = [np.stack([key, y, x, each])[:, (y <= y1) & (x <= x1)] for y in (y0, y0 + 1) for x in (x0, x0 + 1)]
    touched = np.concatenate(touched, 1)
    touched = touched[:, np.lexsort(touched[2::-1])]
    begins = np.flatnonzero(np.append(True, np.any(np.diff(touched[:3], axis=1) != 0, axis=0)))
    places, value = [], []
    for i, j in zip(begins, np.append(begins[1:], touched.shape[1]), strict=True):
        some, (_, ty, tx, one) = touched[3, i:j], touched[:, i]
        packed = np.stack([c[some] for c in columns])
        if j - i < DRAWN:
            places.append((one, ty, tx, None))
            value.append(packed.tobytes())
        else:
            total = np.zeros((TILE, TILE))
            _drawn(total, *packed, int(ty), int(tx), shape)
            found = np.flatnonzero(total.reshape(-1)).astype(np.int32)
            places.append((one, ty, tx, found.tobytes()))
            value.append(total.reshape(-1)[found].tobytes())
    one, ty, tx, at = zip(*places, strict=True)
    named = [table.column(c).combine_chunks().take(pa.array(one, pa.int64())) for c in range(len(by))]
    return pa.RecordBatch.from_arrays([*named, pa.array(ty, pa.int32()), pa.array(tx, pa.int32()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], [*by, "ty", "tx", "at", "value"])


def blurred(image: DataFrame, sigma: float, width: int, height: int) -> DataFrame:
    """Separable Gaussian blur of a sparse image, cut at three sigma, mirrored at the edges."""
    import math

    r = int(TRUNCATE * sigma + 0.5)
    g = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(v / sum(g)).alias("g")) for d, v in zip(range(-r, r + 1), g, strict=True)])

    def along(df: DataFrame, axis: str, size: int) -> DataFrame:
        at = F.pmod(F.col(axis) + F.col("k.d"), F.lit(2 * size))
        spread = df.withColumn("k", F.explode(kernel)).withColumn(axis, F.when(at < size, at).otherwise(2 * size - 1 - at))
        return spread.groupBy("row", "col").agg(F.sum(F.col("value") * F.col("k.g")).alias("value"))

    return along(along(image, "col", width), "row", height)


def tumbling(frame: Column, first: int, size: int) -> Column:
    """Movie frame of a block of ``size`` frames; a last block that is not full is kept."""
    return F.floor((frame - first) / size).cast("int")


def sliding(df: DataFrame, frame: str, first: int, last: int, size: int, step: int | None = None) -> DataFrame:
    """A row for each window [first + i*step, + size) that holds it; short last windows are kept."""
    step = step or max(1, size // 2)
    count = -(-(last - first + 1) // step)
    hi = F.floor((F.col(frame) - first) / step).cast("int")
    lo = F.greatest(F.floor((F.col(frame) - first - size) / step).cast("int") + 1, F.lit(0))
    top = F.least(hi, F.lit(count - 1))
    return df.filter((F.col(frame) >= first) & (F.col(frame) <= last)).withColumn("movie_frame", F.explode(F.when(top >= lo, F.sequence(lo, top))))


def cumulative(blocks: DataFrame, count: int) -> DataFrame:
    """Running sum over blocks of a sparse block movie: a pixel has a row from its first block on.

    Work grows with the pixels that hold something, not with rows times blocks: block sums
    become prefix sums held until the next block that adds to the pixel.
    """
    w = Window.partitionBy("row", "col").orderBy("movie_frame")
    s = blocks.withColumn("value", F.sum("value").over(w)).withColumn("until", F.coalesce(F.lead("movie_frame").over(w) - 1, F.lit(count - 1)))
    return s.select("row", "col", "value", F.explode(F.sequence("movie_frame", "until")).alias("movie_frame"))


def contrast_limits(image: DataFrame, percentile: float = 0.999) -> DataFrame:
    """Zero and a percentile of the pixels that hold something."""
    return image.filter("value > 0").agg(F.lit(0.0).alias("low"), F.percentile("value", percentile).alias("high"), F.count(F.lit(1)).alias("pixels"))


def output_shape(width: int, height: int, over: int) -> tuple[int, int]:
    return height * over, width * over


def estimate_bytes(width: int, height: int, over: int, frames: int = 1) -> int:
    rows, cols = output_shape(width, height, over)
    return 4 * rows * cols * frames


def group_count(first: int, last: int, mode: str, size: int, step: int | None = None) -> int:
    """Movie frames without making the movie."""
    span = last - first + 1
    return -(-span // (size if mode != "sliding" else step or max(1, size // 2)))


def window_close(movie_frame: Column, first: int, size: int, stride: int) -> Column:
    """Frame at which a window's result is shown: its last one."""
    return first + size - 1 + movie_frame * stride


def strided(df: DataFrame, frame: str, first: int, last: int, step: int) -> DataFrame:
    """Rows of every ``step``-th frame of first .. last."""
    f = F.col(frame)
    return df.filter(f.between(first, last) & ((f - first) % max(1, step) == 0))


def fixed_range(df: DataFrame, frame: str, first: int, last: int) -> DataFrame:
    """Rows of the frames of a movie of a fixed range; one that starts past its end is refused."""
    if first > last:
        raise ValueError(f"the range starts at {first}, past its end {last}")
    return df.filter(F.col(frame).between(first, last))


def cropped(image: DataFrame, top: int, bottom: int, left: int, right: int) -> DataFrame:
    """Pixels of rows top .. bottom - 1 and columns left .. right - 1, where they were."""
    return image.filter((F.col("row") >= top) & (F.col("row") < bottom) & (F.col("col") >= left) & (F.col("col") < right))


def rotated(image: DataFrame, quarter_turns: int, width: int, height: int) -> DataFrame:
    """Exact counter-clockwise rotation by quarter turns."""
    r, c = F.col("row"), F.col("col")
    row, col = {0: (r, c), 1: (width - 1 - c, r), 2: (height - 1 - r, width - 1 - c), 3: (c, height - 1 - r)}[quarter_turns % 4]
    return image.withColumn("_r", row).withColumn("_c", col).drop("row", "col").withColumnsRenamed({"_r": "row", "_c": "col"})


def blended(layers: DataFrame) -> DataFrame:
    """Additive composite of layers (row, col, r, g, b), clipped to 255."""
    return layers.groupBy("row", "col").agg(*[F.least(F.sum(c), F.lit(255)).cast("int").alias(c) for c in "rgb"])


def forced_groups(movie: DataFrame, count: int, columns: tuple[str, ...] = ("n",)) -> DataFrame:
    """A row for each movie frame 0 .. count - 1, also for those that no localization falls in; later
    ones are left out."""
    groups = movie.sparkSession.range(count).select(F.col("id").cast("int").alias("movie_frame"))
    return groups.join(movie, "movie_frame", "left").fillna(0, list(columns))


def frame_interval(interval_s: float, stride: int) -> float:
    """Seconds between the shown frames of a movie that shows every ``stride``-th."""
    return interval_s * max(1, stride)
