"""Range, region and default filters over localization tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from glimmer.functions.scalars import outward

Bounds = dict[str, tuple[float | None, float | None]]


def _within(df: DataFrame, name: str, low: float | None, high: float | None) -> Column:
    c = F.col(f"`{name}`")
    parts = [c.isNotNull()]
    if isinstance(df.schema[name].dataType, DoubleType | FloatType):
        parts.append(~F.isnan(c))
    if low is not None:
        parts.append(c >= low)
    if high is not None:
        parts.append(c <= high)
    return reduce(and_, parts)


def _parts(df: DataFrame, bounds: Bounds) -> list[Column]:
    return [_within(df, k, lo, hi) for k, (lo, hi) in bounds.items() if k in df.columns and (lo is not None or hi is not None)]


def inside(df: DataFrame, bounds: Bounds) -> Column:
    """Whether a row is inside all bounds: both ends included, a side may be open, NaN and NULL are
    outside, an unknown column is ignored.  Never NULL."""
    return reduce(and_, _parts(df, bounds), F.lit(True))


def range_filter(df: DataFrame | None, bounds: Bounds) -> DataFrame | None:
    """Rows inside all bounds.  No table gives no table, no bounds the table itself."""
    if df is None or not _parts(df, bounds):
        return df
    return df.filter(inside(df, bounds))


def roi_filter(df: DataFrame, roi_px: tuple[float, float, float, float], pixel_nm: float, x: str = "x_nm", y: str = "y_nm") -> DataFrame:
    """Rectangle (x0, y0, x1, y1) in pixels over positions in nm."""
    x0, y0, x1, y1 = (v * pixel_nm for v in roi_px)
    return range_filter(df, {x: (x0, x1), y: (y0, y1)})


def default_bounds(df: DataFrame, columns: list[str], decimals: int = 6) -> DataFrame:
    """One row per column: its data range, rounded outward; sigma columns get 0 to 500 nm."""
    fixed = {c for c in columns if c.lower().startswith("sigma")}
    ranges = df.agg(*[F.struct(outward(F.min(c), decimals, False).alias("low"), outward(F.max(c), decimals, True).alias("high")).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), (F.lit(0.0) if c in fixed else F.col(c)["low"]).alias("low"), (F.lit(500.0) if c in fixed else F.col(c)["high"]).alias("high")) for c in columns]
    return ranges.select(F.inline(F.array(*rows)))


def merged_bounds(saved: Bounds, data: Bounds) -> Bounds:
    """A saved side wins; the other side follows the data."""
    out = dict(data)
    for name, (low, high) in saved.items():
        lo, hi = data.get(name, (None, None))
        out[name] = (lo if low is None else low, hi if high is None else high)
    return out


def shift_frames(df: DataFrame, k: int, frame: str = "frame") -> DataFrame:
    return df.withColumn(frame, F.col(frame) + k)


def infer_roles(columns: list[str]) -> dict[str, str]:
    """Roles of columns by name: x, y, frame, sigma, intensity."""
    out: dict[str, str] = {}
    for c in columns:
        name = c.lower().split("[")[0].strip().removesuffix("_nm")
        role = {"x": "x", "y": "y", "frame": "frame", "intensity": "intensity"}.get(name)
        if role is None and is_sigma(c):
            role = "sigma"
        if role and role not in out:
            out[role] = c
    return out


def is_sigma(name: str) -> bool:
    base = name.lower().split("[")[0].strip()
    return base == "sigma" or base.startswith("sigma") and (base[5:6] in "_1234567890")


def histograms(df: DataFrame, column: str | Column, width: float, kept: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bin, n_all, n_kept): a column's histogram over all rows and over those that a filter keeps."""
    value = F.col(column) if isinstance(column, str) else column
    return df.groupBy(*by, F.floor(value / width).alias("bin")).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(kept).alias("n_kept"))


def share_above(df: DataFrame, column: str, cutoff: float) -> DataFrame:
    """One row: the share of the rows above a cutoff, rows without a value left out."""
    return df.filter(F.col(column).isNotNull()).agg(F.avg((F.col(column) > cutoff).cast("double")).alias("share_above"))


def concatenated(tables: list[DataFrame]) -> DataFrame:
    """Localization tables one after another, ordered by frame; rows of one frame stay in the order
    of the tables and of their rows, which ``part`` and ``place`` keep for later sorts."""
    parts = [t.withColumn("part", F.lit(k)).withColumn("place", F.monotonically_increasing_id()) for k, t in enumerate(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy("frame", "part", "place")
