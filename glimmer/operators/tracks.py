"""Trajectory operators: lengths, paths, immobility, mean square displacement, classes, merging.

All group by ``particle``; a pipeline that uses several of them shuffles once if the
points are repartitioned by it and kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from glimmer.functions.scalars import sigma_from_msd, static_p_value
from glimmer.operators.filters import Bounds, range_filter


def _by() -> WindowSpec:
    return Window.partitionBy("particle")


def _in_order() -> WindowSpec:
    return _by().orderBy("frame")


def length_filter(points: DataFrame, least: int) -> DataFrame:
    """Points of trajectories with at least ``least`` points; up to 1 keeps all."""
    if least <= 1:
        return points
    return points.withColumn("_n", F.count(F.lit(1)).over(_by())).filter(F.col("_n") >= least).drop("_n")


def steps(points: DataFrame) -> DataFrame:
    """Consecutive points of a trajectory: frame, gap in frames, dx, dy, length."""
    lag = lambda c: F.lag(c).over(_in_order())
    out = points.select("particle", "frame", (F.col("frame") - lag("frame")).alias("gap"), (F.col("x") - lag("x")).alias("dx"), (F.col("y") - lag("y")).alias("dy"))
    return out.filter("gap IS NOT NULL").withColumn("length", F.hypot("dx", "dy"))


def path_metrics(points: DataFrame, pixel_um: float, fps: float) -> DataFrame:
    """One row per trajectory: n, distance, net displacement, straightness, duration."""
    at = F.struct("x", "y")
    s = points.select("particle", "frame", "x", "y", F.hypot(F.col("x") - F.lag("x").over(_in_order()), F.col("y") - F.lag("y").over(_in_order())).alias("step"))
    g = s.groupBy("particle").agg(
        F.count(F.lit(1)).alias("n"),
        (F.coalesce(F.sum("step"), F.lit(0.0)) * pixel_um).alias("distance_um"),
        F.min_by(at, "frame").alias("a"),
        F.max_by(at, "frame").alias("b"),
        ((F.max("frame") - F.min("frame")) / fps).alias("duration_s"),
    )
    g = g.withColumn("net_displacement_um", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")) * pixel_um)
    return g.select("particle", "n", "distance_um", "net_displacement_um", (F.col("net_displacement_um") / F.nullif("distance_um", F.lit(0.0))).alias("straightness"), "duration_s")


def usable_sigma(sigma: Column, fallback: float | None = None, calibration: float = 1.0) -> Column:
    """A precision that is present and positive, else the fallback, times a calibration."""
    ok = F.when((sigma > 0) & ~F.isnan(sigma), sigma)
    return (F.coalesce(ok, F.lit(fallback)) if fallback else ok) * calibration


def immobility(points: DataFrame, sigma: Column) -> DataFrame:
    """Static test per trajectory: statistic, dof, p_static, motion_ratio.

    The statistic is the weighted scatter about the weighted mean, in two passes over the
    same partitioning, which avoids the cancellation of the one-pass form.  Points without
    a precision are left out; one point gives a NULL statistic.
    """
    w = points.select("particle", "x", "y", (1.0 / F.nullif(sigma * sigma, F.lit(0.0))).alias("w")).filter("w IS NOT NULL")
    total = F.sum("w").over(_by())
    r = w.withColumn("mx", F.sum(F.col("w") * F.col("x")).over(_by()) / total).withColumn("my", F.sum(F.col("w") * F.col("y")).over(_by()) / total)
    sq = F.col("w") * (F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2))
    g = r.groupBy("particle").agg(F.count(F.lit(1)).alias("n"), F.sum(sq).alias("scatter"))
    g = g.select("particle", "n", F.when(F.col("n") > 1, F.col("scatter")).alias("statistic"), (2 * (F.col("n") - 1)).alias("dof"))
    return g.withColumn("p_static", static_p_value(F.col("statistic"), F.col("n"))).withColumn("motion_ratio", F.col("statistic") / F.nullif("dof", F.lit(0)))


def msd(points: DataFrame, max_lag: int, pixel_um: float) -> DataFrame:
    """Mean square displacement (um2) by trajectory and lag in frames; gaps are respected.

    The lags are spread out on one side and met by equality of (particle, frame), so a long
    trajectory costs its points times ``max_lag``, not their square.
    """
    a = points.select("particle", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"), "frame", "x", "y")
    a = a.select("particle", "lag", (F.col("frame") + F.col("lag")).alias("frame"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    met = a.join(points.select("particle", "frame", "x", "y"), ["particle", "frame"])
    sq = (F.pow(F.col("x") - F.col("x0"), 2) + F.pow(F.col("y") - F.col("y0"), 2)) * pixel_um**2
    return met.groupBy("particle", "lag").agg(F.avg(sq).alias("msd_um2"), F.count(F.lit(1)).alias("pairs"))


def msd_fit(table: DataFrame, interval_s: float) -> DataFrame:
    """Line through the mean square displacements: slope, intercept, stderr of the slope, D."""
    t = F.col("lag") * interval_s
    g = table.groupBy("particle").agg(
        F.count(F.lit(1)).alias("lags"), F.regr_slope("msd_um2", t).alias("slope"), F.regr_intercept("msd_um2", t).alias("intercept"),
        F.regr_sxx("msd_um2", t).alias("sxx"), F.regr_syy("msd_um2", t).alias("syy"), F.regr_sxy("msd_um2", t).alias("sxy"),
    )
    sse = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.nullif("sxx", F.lit(0.0)), F.lit(0.0))
    err = F.when((F.col("lags") > 2) & (F.col("sxx") > 0), F.sqrt(sse / F.nullif(F.col("lags") - 2, F.lit(0)) / F.nullif("sxx", F.lit(0.0))))
    return g.select("particle", "lags", "slope", "intercept", err.alias("slope_stderr"), (F.col("slope") / 4.0).alias("d_um2_per_s"))


def dynamics_filter(points: DataFrame, metrics: DataFrame, bounds: Bounds) -> DataFrame:
    """Points whose trajectory's metrics are all in range; without a bound, all points."""
    if not bounds:
        return points
    return points.join(range_filter(metrics, bounds).select("particle"), "particle", "left_semi")


def classify(metrics: DataFrame, alpha: float = 0.05, d_max: float = 0.01, least_points: int = 3) -> DataFrame:
    """Mobile, immobile or undetermined, from the static test and the detectable diffusion."""
    immobile = (F.col("p_static") >= alpha) & (F.col("d_detectable") <= d_max) & (F.col("n") >= least_points)
    name = F.when(F.col("p_static") < alpha, "mobile").when(F.coalesce(immobile, F.lit(False)), "immobile").otherwise("undetermined")
    return metrics.withColumn("class", name)


def classify_by_fit(posteriors: DataFrame, p: float) -> DataFrame:
    name = F.when(F.col("p_immobile") >= p, "immobile").when(1 - F.col("p_immobile") >= p, "mobile").otherwise("undetermined")
    return posteriors.withColumn("class", name)


def merge(table: DataFrame, merge_ids: DataFrame, sum_columns: tuple[str, ...] = ("photons",), fallback_sigma: float | None = None) -> DataFrame:
    """Each trajectory of ``merge_ids`` becomes one localization, the others stay.

    Position: mean weighted by 1/sigma2; sigma: of the mean, widened by the root of the
    reduced chi-square above 1; ``sum_columns`` add up, other numbers are averaged; the
    frame is the first, ``frame_last`` the last.  A missing sigma is the fallback, else the
    median of the merged rows, else 1.
    """
    ids = merge_ids.select("particle").distinct()
    rest = table.join(ids, "particle", "left_anti").withColumn("n_merged", F.lit(1).cast("long")).withColumn("frame_last", F.col("frame"))
    inside = table.join(ids, "particle", "left_semi").filter("particle >= 0")
    rest = rest.unionByName(table.join(ids, "particle", "left_semi").filter("particle < 0").withColumn("n_merged", F.lit(1).cast("long")).withColumn("frame_last", F.col("frame")))
    good = F.when((F.col("sigma") > 0) & ~F.isnan("sigma"), F.col("sigma"))
    middle = F.lit(fallback_sigma) if fallback_sigma else F.col("_median")
    if not fallback_sigma:
        inside = inside.crossJoin(F.broadcast(inside.agg(F.percentile(good, 0.5).alias("_median"))))  # one row
    w = inside.withColumn("_s", F.coalesce(good, middle, F.lit(1.0))).withColumn("_w", 1.0 / (F.col("_s") * F.col("_s")))
    total = F.sum("_w").over(_by())
    w = w.withColumn("_mx", F.sum(F.col("_w") * F.col("x")).over(_by()) / total).withColumn("_my", F.sum(F.col("_w") * F.col("y")).over(_by()) / total)
    sq = F.col("_w") * (F.pow(F.col("x") - F.col("_mx"), 2) + F.pow(F.col("y") - F.col("_my"), 2))
    dof = 2 * (F.count(F.lit(1)) - 1)
    ratio = F.when(dof > 0, F.sum(sq) / F.nullif(dof, F.lit(0))).otherwise(1.0)
    aggs = [F.sum("_w").alias("_total")]
    for name, kind in table.dtypes:
        if name == "particle":
            continue
        if name == "x":
            e = F.first("_mx")
        elif name == "y":
            e = F.first("_my")
        elif name == "frame":
            e = F.min("frame")
        elif name == "sigma":
            e = F.sqrt(1.0 / F.sum("_w")) * F.sqrt(F.greatest(ratio, F.lit(1.0)))
        elif name in sum_columns:
            e = F.sum(name)
        elif kind in ("string", "boolean"):
            e = F.lit(None).cast(kind)
        else:
            e = F.avg(name).cast("double" if kind not in ("float",) else kind)
        aggs.append(e.alias(name))
    merged = w.groupBy("particle").agg(*aggs, F.count(F.lit(1)).alias("n_merged"), F.max("frame").alias("frame_last")).drop("_total")
    return rest.unionByName(merged.select(*[F.col(c) for c in rest.columns]))


def attach_trajectory(locs: DataFrame, points: DataFrame, pixel_nm: float) -> DataFrame:
    """Particle of each localization by frame and position (to a millionth of a pixel); -1 for none."""
    key = lambda c: F.round(F.col(c) * 1e6).cast("long")
    left = locs.withColumn("_x", F.round(F.col("x_nm") / pixel_nm * 1e6).cast("long")).withColumn("_y", F.round(F.col("y_nm") / pixel_nm * 1e6).cast("long"))
    right = points.groupBy("frame", key("x").alias("_x"), key("y").alias("_y")).agg(F.min("particle").alias("particle"))
    return left.join(right, ["frame", "_x", "_y"], "left").drop("_x", "_y").withColumn("particle", F.coalesce("particle", F.lit(-1)))


def resampled(points: DataFrame, spacing: float) -> DataFrame:
    """Points along each step at most ``spacing`` apart, with the step's first frame."""
    lead = lambda c: F.lead(c).over(_in_order())
    s = points.select("particle", "frame", "x", "y", lead("x").alias("x1"), lead("y").alias("y1")).filter("x1 IS NOT NULL")
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")) / spacing)).cast("int")
    s = s.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    w = F.col("k") / F.col("n")
    return s.select("particle", "frame", "k", (F.col("x") + (F.col("x1") - F.col("x")) * w).alias("x"), (F.col("y") + (F.col("y1") - F.col("y")) * w).alias("y"))


def trail(points: DataFrame, current: int, tail: int) -> DataFrame:
    """Points shown at a frame with a tail of that many frames (at least one)."""
    return points.filter((F.col("frame") <= current) & (F.col("frame") > current - max(1, tail)))


def time_span(points: DataFrame) -> DataFrame:
    """First and last frame of each trajectory."""
    return points.groupBy("particle").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


def precision_check(points: DataFrame, fit: DataFrame, sigma: Column) -> DataFrame:
    """The precision that the fits report (median over a trajectory's usable ones) against the one
    that the intercept of its mean square displacements shows: sigma_fit, sigma_msd, ratio (nm)."""
    told = points.groupBy("particle").agg(F.median(usable_sigma(sigma)).alias("sigma_fit"), F.count(F.lit(1)).alias("n"))
    shown = fit.select("particle", sigma_from_msd(F.col("intercept")).alias("sigma_msd"))
    met = told.join(shown, "particle", "left")
    return met.withColumn("ratio", F.col("sigma_msd") / F.nullif(F.col("sigma_fit"), F.lit(0.0)))


def binned_settings(n: int, offset: float, fps: float, previous: int = 1) -> tuple[float, float]:
    """Camera offset and frame rate after n frames are added up, from those that hold for bins of
    ``previous`` frames: offsets add up, the rate falls; the pixel size stays."""
    factor = max(1, n) / max(1, previous)
    return offset * factor, fps / factor
