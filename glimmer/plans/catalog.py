"""The registered queries of the domain operators, each with the SQL of an independent engine.

``R`` rounds doubles to six places on both sides, as the order of sums differs; where the
values would lie on ties, both sides add the same 1.23e-8 before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.functions import scalars as S
from glimmer.operators import drift as D
from glimmer.operators import filters, render, selection, spots, timejoin
from glimmer.operators import tracks as T
from glimmer.plans import bridge as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql.replace(" round(", " 0.0 + round(")  # never a negative zero
        return fn

    return register


def R(c: Column | str, name: str | None = None, places: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, places) + F.lit(0.0)).alias(name or (c if isinstance(c, str) else ""))


PATHS = """steps AS (
  SELECT particle, frame, x, y, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step
  FROM tracks WINDOW w AS (PARTITION BY particle ORDER BY frame)),
paths AS (
  SELECT particle, count(*) AS n, coalesce(sum(step), 0) * 0.1 AS distance,
         sqrt(power(max_by(x, frame) - min_by(x, frame), 2) + power(max_by(y, frame) - min_by(y, frame), 2)) * 0.1 AS net,
         (max(frame) - min(frame)) / 20.0 AS duration
  FROM steps GROUP BY particle)"""


@query(f"""{B.sql('tracks')}, {PATHS}
SELECT particle, n, round(distance, 6) AS distance_um, round(net, 6) AS net_displacement_um, round(net / nullif(distance, 0), 6) AS straightness, round(duration, 6) AS duration_s
FROM paths WHERE n >= 60""")
def track_path_metrics(spark, d):
    m = T.path_metrics(T.length_filter(B.tracks(spark, d), 60), 0.1, 20.0)
    return m.select("particle", "n", R("distance_um"), R("net_displacement_um"), R("straightness"), R("duration_s"))


@query(f"""{B.sql('locs')} SELECT * FROM locs WHERE sigma_nm BETWEEN 120 AND 200 AND photons BETWEEN 500 AND 1800 AND uncertainty_nm <= 30""")
def range_filter_multi(spark, d):
    return filters.range_filter(B.locs(spark, d), {"sigma_nm": (120, 200), "photons": (500, 1800), "uncertainty_nm": (None, 30), "no_such_column": (0, 1)})


@query(f"""{B.sql('locs')} SELECT * FROM locs WHERE net_gradient >= 50000""")
def range_filter_one_sided(spark, d):
    return filters.range_filter(B.locs(spark, d), {"net_gradient": (50000, None)})


@query(f"""{B.sql('tracks')} SELECT particle, frame, x, y FROM tracks QUALIFY count(*) OVER (PARTITION BY particle) >= 70""")
def length_filter(spark, d):
    return T.length_filter(B.tracks(spark, d), 70).select("particle", "frame", "x", "y")


@query(f"""{B.sql('locs')} SELECT frame, x, y, photons FROM locs WHERE x * 100 BETWEEN 1000 AND 3000 AND y * 100 BETWEEN 500 AND 2500""")
def roi_filter(spark, d):
    l = B.locs(spark, d).withColumn("x_nm", F.col("x") * 100).withColumn("y_nm", F.col("y") * 100)  # noqa: E741
    return filters.roi_filter(l, (10, 5, 30, 25), 100.0).select("frame", "x", "y", "photons")


@query(f"""{B.sql('locs')} SELECT 'x' AS "column", floor(min(x) * 1e6) / 1e6 AS low, ceil(max(x) * 1e6) / 1e6 AS high FROM locs
UNION ALL SELECT 'photons', floor(min(photons) * 1e6) / 1e6, ceil(max(photons) * 1e6) / 1e6 FROM locs UNION ALL SELECT 'sigma_nm', 0, 500""")
def default_bounds(spark, d):
    return filters.default_bounds(B.locs(spark, d), ["x", "photons", "sigma_nm"])


@query(f"""{B.sql('locs')} SELECT frame - 1 AS frame, count(*) AS n FROM locs GROUP BY 1""")
def frame_shift(spark, d):
    return filters.shift_frames(B.locs(spark, d), -1).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(vec_id // 7 AS INTEGER) AS bin, round(sum(list_sum(CAST(embedding AS DOUBLE[]))) + 1.23e-8, 5) AS total
FROM embeddings WHERE vec_id < ((SELECT max(vec_id) FROM embeddings) + 1) // 7 * 7 GROUP BY 1""")
def time_bin_sum_drop_tail(spark, d):
    return spots.time_binned(_patches(spark, d), 7).select(F.col("frame").alias("bin"), R(_pixel_sum("pixels") + 1.23e-8, "total", 5))


def _patches(spark, d) -> DataFrame:
    """The 8 x 8 embeddings as frames of pixels."""

    def run(batches):
        for f in batches:
            pixels = [np.asarray(e, np.float64).tobytes() for e in f["embedding"]]
            yield pd.DataFrame({"frame": f["vec_id"].astype("int32"), "height": 8, "width": 8, "pixels": pixels})

    return B.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "frame int, height int, width int, pixels binary")


def _pixel_sum(column: str) -> Column:
    @F.pandas_udf("double")
    def total(pixels: pd.Series) -> pd.Series:
        return pixels.map(lambda b: float(np.frombuffer(b, np.float64).sum()))

    return total(column)


def _crlb(mle: bool) -> str:
    tau = "2 * pi() * (power(s, 2) + 1 / 12.0) * b / n"
    f = f"1 + 4 * {tau} + sqrt(2 * {tau} / (1 + 4 * {tau}))" if mle else f"16 / 9.0 + 4 * {tau}"
    return f"""{B.sql('locs')}, p AS (SELECT frame, x, y, greatest(photons, 1) AS n, uncertainty_nm AS b, sigma_nm / 100 AS s FROM locs)
SELECT frame, x, y, round(greatest(sqrt((power(s, 2) + 1 / 12.0) / n * ({f})), {0.02 if mle else 0.05}), 6) AS lp FROM p"""


def _precision(spark, d, mle: bool) -> DataFrame:
    p = S.localization_precision(F.col("photons"), F.col("uncertainty_nm"), F.col("sigma_nm") / 100, mle)
    return B.locs(spark, d).select("frame", "x", "y", R(S.floored_precision(p, mle), "lp"))


@query(_crlb(True))
def crlb_mle(spark, d):
    return _precision(spark, d, True)


@query(_crlb(False))
def crlb_lsq(spark, d):
    return _precision(spark, d, False)


@query(f"""{B.sql('locs')} SELECT frame, x, y, round(2 * pi() * net_gradient / 1000 * (sigma_nm / 100) * (uncertainty_nm / 10), 4) AS spot_photons, round(greatest((photons - 400) / 1.3, 0), 6) AS calibrated FROM locs""")
def photometry(spark, d):
    return B.locs(spark, d).select("frame", "x", "y", R(S.gaussian_photons(F.col("net_gradient") / 1000, F.col("sigma_nm") / 100, F.col("uncertainty_nm") / 10), "spot_photons", 4), R(S.camera_photons(F.col("photons"), 400.0, 1.3), "calibrated"))


@query(f"""{B.sql('tracks')} SELECT particle, frame, round(CASE WHEN sigma > 0 THEN power(sigma * 20, 2) * 1e-6 / (4 * 0.03 * (frame % 4 + 1) * ln(100)) END, 6) AS d_max,
round(sqrt(4 * 0.1 * 0.03 * (frame % 4 + 1) * 1e6), 6) AS rms_nm FROM tracks""")
def linkable_d(spark, d):
    m = F.col("frame") % 4
    return B.tracks(spark, d).select("particle", "frame", R(S.linkable_d(F.col("sigma") * 20, F.lit(0.03), m), "d_max"), R(S.rms_step_nm(F.lit(0.1), F.lit(0.03), m), "rms_nm"))


CAMERA = (1.02, -0.03, 0.05, 0.97)


@query(f"""{B.sql('record')} SELECT t, round(1.02 * dx - 0.03 * dy + 1.23e-8, 6) AS dx, round(0.05 * dx + 0.97 * dy + 1.23e-8, 6) AS dy, round(sqrt(abs(1.02 * 0.97 + 0.03 * 0.05)), 6) AS scale, round(degrees(atan2(0.05 + 0.03, 1.02 + 0.97)), 6) AS rotation FROM record""")
def camera_map_displacement(spark, d):
    x, y = S.matrix_map(F.col("dx"), F.col("dy"), CAMERA)
    return B.record(spark, d).select("t", R(x + 1.23e-8, "dx"), R(y + 1.23e-8, "dy"), F.round(F.lit(S.matrix_scale(CAMERA)), 6).alias("scale"), F.round(F.lit(S.matrix_rotation(CAMERA)), 6).alias("rotation"))


@query(f"""{B.sql('locs')}, series AS (SELECT frame, avg(photons) AS dx FROM locs WHERE frame < 800 GROUP BY frame)
SELECT l.frame, x, y, l.frame > 799 AS outside, round(s.dx, 6) AS dx FROM locs l LEFT JOIN series s ON s.frame = least(greatest(l.frame, 0), 799)""")
def drift_clamped_lookup(spark, d):
    l = B.locs(spark, d)  # noqa: E741
    series = l.filter("frame < 800").groupBy("frame").agg(F.avg("photons").alias("dx"))
    return timejoin.clamped_lookup(l.select("frame", "x", "y"), series, "frame", ["dx"], 800).select("frame", "x", "y", "outside", R("dx"))


FRAMES = "frames AS (SELECT DISTINCT event_id % 7000 AS frame, (event_id % 7000) * 1.3 - 20 AS t FROM events)"


def _frames(spark, d):
    k = F.col("event_id") % 7000
    return B.table(spark, d, "events").select(k.alias("frame"), (k * 1.3 - 20).alias("t")).distinct()


@query(f"""{B.sql('record')}, {FRAMES}, o AS (SELECT f.frame, r.t AS r_t, r.dx, row_number() OVER (PARTITION BY f.frame ORDER BY abs(f.t - r.t), r.t) AS k FROM frames f, record r)
SELECT frame, r_t, round(dx, 6) AS dx FROM o WHERE k = 1""")
def asof_nearest(spark, d):
    return timejoin.nearest(_frames(spark, d), B.record(spark, d).withColumnRenamed("t", "r_t"), "t", "r_t", ["dx"], 500.0).select("frame", F.col("r_t_found").alias("r_t"), R("dx"))


@query(f"""{B.sql('record')}, {FRAMES},
b AS (SELECT f.frame, f.t, r.t AS t0, r.dx AS a FROM frames f ASOF LEFT JOIN record r ON f.t >= r.t),
c AS (SELECT b.*, r.t AS t1, r.dx AS e FROM b ASOF LEFT JOIN record r ON b.t < r.t)
SELECT frame, round(CASE WHEN t0 IS NULL THEN e WHEN t1 IS NULL THEN a ELSE a + (e - a) * ((t - t0) / (t1 - t0)) END, 6) AS dx FROM c""")
def asof_interp(spark, d):
    return timejoin.interpolated(_frames(spark, d), B.record(spark, d), "t", "t", ["dx"], 500.0).select("frame", R("dx"))


CLOCK = """line AS (SELECT regr_slope(t, page) AS slope, regr_intercept(t, page) AS intercept, count(*) AS n FROM pages_t WHERE backlog <= 1),
res AS (SELECT t - intercept - slope * page AS r, slope, intercept, n FROM pages_t, line WHERE backlog <= 1),
q AS (SELECT quantile_cont(r, 0.5) AS med, quantile_cont(r, 0.05) AS p5 FROM res),
clock AS (SELECT slope, intercept + any_value(p5) + 0.01 AS intercept, n, n >= 10 AND slope > 0 AND quantile_cont(abs(r - med), 0.5) < 0.003 AS regular FROM res, q GROUP BY slope, intercept, n)"""


@query(f"""{B.sql('pages')}, {CLOCK} SELECT round(slope, 9) AS slope, round(intercept, 6) AS intercept, n, regular FROM clock""")
def frame_clock_regression(spark, d):
    return D.frame_clock(B.pages(spark, d), 0.02).select(R("slope", places=9), R("intercept"), "n", "regular")


@query(f"""{B.sql('pages')}, {CLOCK} SELECT range AS page, round(coalesce(t, intercept + slope * range), 6) AS t, t IS NULL AS extrapolated FROM range(6000) LEFT JOIN pages_t ON page = range, clock""")
def clock_extrapolate(spark, d):
    p = B.pages(spark, d)
    return D.extrapolated(p, D.frame_clock(p, 0.02), 6000).select("page", R("t"), "extrapolated")


@query(f"""{B.sql('record')}, s AS (SELECT t, t - lag(t) OVER w AS dt, dx - 2 * lag(dx) OVER w + lag(dx, 2) OVER w AS d2 FROM record WINDOW w AS (ORDER BY t))
SELECT max(t) - min(t) AS span, quantile_cont(dt, 0.5) AS "interval", round(var_pop(d2) / 6, 6) AS noise_var, count(*) AS n FROM s""")
def second_difference_noise(spark, d):
    return D.record_stats(B.record(spark, d)).select("span", "interval", R("noise_var"), "n")


@query(f"""{B.sql('record')}, s AS (SELECT t, lag(t) OVER w AS t_before, sqrt(power(dx - lag(dx) OVER w, 2) + power(dy - lag(dy) OVER w, 2)) AS jump FROM record WINDOW w AS (ORDER BY t))
SELECT t, t_before, round(jump, 6) AS jump FROM s WHERE jump > 2""")
def abrupt_steps(spark, d):
    return D.abrupt_steps(B.record(spark, d), 2.0).select("t", "t_before", R("jump"))


MERGE = """ids AS (SELECT particle FROM tracks GROUP BY particle HAVING particle % 3 = 0),
ins AS (SELECT *, 1 / (sigma * sigma) AS w FROM tracks WHERE particle IN (SELECT particle FROM ids)),
mean AS (SELECT *, sum(w * x) OVER p / sum(w) OVER p AS mx, sum(w * y) OVER p / sum(w) OVER p AS my FROM ins WINDOW p AS (PARTITION BY particle)),
merged AS (SELECT particle, min(frame) AS frame, min(mx) AS x, min(my) AS y,
    sqrt(1 / sum(w)) * sqrt(greatest(CASE WHEN count(*) > 1 THEN sum(w * (power(x - mx, 2) + power(y - my, 2))) / (2.0 * (count(*) - 1)) ELSE 1 END, 1)) AS sigma,
    sum(photons) AS photons, count(*) AS n_merged, max(frame) AS frame_last FROM mean GROUP BY particle)"""


def _merged(spark, d):
    t = B.tracks(spark, d)
    return T.merge(t, t.filter("particle % 3 = 0").select("particle"))


@query(f"""{B.sql('tracks')}, {MERGE} SELECT particle, frame, round(x, 6) AS x, round(y, 6) AS y, round(sigma, 6) AS sigma, round(photons, 4) AS photons, n_merged, frame_last FROM merged""")
def merge_trajectories(spark, d):
    return _merged(spark, d).filter("particle % 3 = 0").select("particle", "frame", R("x"), R("y"), R("sigma"), R("photons", places=4), "n_merged", "frame_last")


@query(f"""{B.sql('tracks')}, {MERGE} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(n_merged) AS BIGINT) AS merged, count(DISTINCT particle) AS particles FROM (
SELECT particle, n_merged FROM merged UNION ALL SELECT particle, 1 FROM tracks WHERE particle NOT IN (SELECT particle FROM ids))""")
def union_rest_merged(spark, d):
    return _merged(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum("n_merged").alias("merged"), F.countDistinct("particle").alias("particles"))


STATIC = """m AS (SELECT *, power(1 / (sigma / 1000 * 60), 2) AS w FROM walks),
mean AS (SELECT *, sum(w * x) OVER p / sum(w) OVER p AS mx, sum(w * y) OVER p / sum(w) OVER p AS my FROM m WINDOW p AS (PARTITION BY particle)),
stat AS (SELECT particle, count(*) AS n, CASE WHEN count(*) > 1 THEN sum(w * (power(x - mx, 2) + power(y - my, 2))) END AS t FROM mean GROUP BY particle),
p AS (SELECT particle, n, t, exp(-t / 2) * (SELECT sum(exp(k * ln(greatest(t, 1e-300) / 2) - lgamma(k + 1.0))) FROM (SELECT unnest(range(0, n - 1)) AS k)) AS p_static FROM stat WHERE n >= 2)"""


def _static(spark, d):
    w = B.walks(spark, d).select("particle", "frame", "x", "y", (F.col("sigma") / 1000 * 60).alias("s"))
    return T.immobility(w, F.col("s"))


@query(f"""{B.sql('walks')}, {STATIC} SELECT particle, n, round(t, 4) AS statistic, round(t / nullif(2 * (n - 1), 0), 6) AS motion_ratio FROM stat""")
def motion_ratio(spark, d):
    return _static(spark, d).select("particle", "n", R("statistic", places=4), R("motion_ratio"))


SHORT = """short AS (SELECT particle * 1000 + frame // 5 AS particle, frame, x, y, sigma FROM walks)"""


def _short(spark, d):
    return B.walks(spark, d).withColumn("particle", F.col("particle") * 1000 + F.floor(F.col("frame") / 5))


def _short_static(spark, d):
    s = _short(spark, d).withColumn("s", F.col("sigma") / 1000 * 4)
    return T.immobility(s, F.col("s"))


SHORT_STATIC = f"{B.sql('walks')}, {SHORT}, {STATIC}".replace("FROM walks)", "FROM short)", 2).replace("FROM short)", "FROM walks)", 1).replace("* 60", "* 4")


@query(f"""{SHORT_STATIC} SELECT particle, n, round(p_static, 6) AS p_static FROM p""")
def p_static(spark, d):
    return _short_static(spark, d).filter("n >= 2").select("particle", "n", R("p_static"))


CLASSES = f"""{SHORT_STATIC}, c AS (SELECT particle, CASE WHEN p_static < 0.05 THEN 'mobile' WHEN p_static >= 0.05 AND 0.04 / n <= 0.01 AND n >= 3 THEN 'immobile' ELSE 'undetermined' END AS class FROM p)"""


def _classes(spark, d):
    return T.classify(_short_static(spark, d).filter("n >= 2").withColumn("d_detectable", 0.04 / F.col("n")))


@query(f"{CLASSES} SELECT particle, class FROM c")
def class_partition(spark, d):
    return _classes(spark, d).select("particle", "class")


@query(f"{CLASSES} SELECT class, count(*) AS n FROM c GROUP BY class")
def class_counts(spark, d):
    return _classes(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


MSD = "msd AS (SELECT a.particle, b.frame - a.frame AS lag, avg(power(b.x - a.x, 2) + power(b.y - a.y, 2)) * 0.01 AS msd, count(*) AS pairs FROM walks a JOIN walks b ON a.particle = b.particle AND b.frame - a.frame BETWEEN 1 AND 5 GROUP BY 1, 2)"


def _msd(spark, d):
    return T.msd(B.walks(spark, d), 5, 0.1)


@query(f"{B.sql('walks')}, {MSD} SELECT particle, lag, round(msd + 1.23e-11, 8) AS msd_um2, pairs FROM msd")
def msd_by_lag(spark, d):
    return _msd(spark, d).select("particle", F.col("lag").cast("long").alias("lag"), R(F.col("msd_um2") + 1.23e-11, "msd_um2", 8), "pairs")


FIT = f"""{B.sql('walks')}, {MSD}, f AS (SELECT particle, count(*) AS lags, regr_slope(msd, lag * 0.03) AS slope, regr_intercept(msd, lag * 0.03) AS intercept,
 regr_sxx(msd, lag * 0.03) AS sxx, regr_syy(msd, lag * 0.03) AS syy, regr_sxy(msd, lag * 0.03) AS sxy FROM msd GROUP BY particle)"""


@query(f"""{FIT} SELECT particle, lags, round(slope, 6) AS slope, round(slope / 4, 6) AS d_um2_per_s,
round(CASE WHEN lags > 2 AND sxx > 0 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (lags - 2) / sxx) END, 6) AS slope_stderr FROM f""")
def msd_slope_stderr(spark, d):
    return T.msd_fit(_msd(spark, d), 0.03).select("particle", "lags", R("slope"), R("d_um2_per_s"), R("slope_stderr"))


@query(f"""{FIT} SELECT particle, round(CASE WHEN intercept > 0 THEN sqrt(intercept) / 2 * 1000 END, 3) AS sigma_nm, avg(CASE WHEN slope / 4 > 0.05 THEN 1.0 ELSE 0.0 END) OVER () AS share_above FROM f""")
def sigma_from_msd(spark, d):
    f = T.msd_fit(_msd(spark, d), 0.03)
    above = filters.share_above(f, "d_um2_per_s", 0.05)
    return f.crossJoin(F.broadcast(above)).select("particle", R(S.sigma_from_msd(F.col("intercept")), "sigma_nm", 3), "share_above")  # one row


@query(f"""{B.sql('tracks')}, {PATHS} SELECT t.particle, t.frame, t.x FROM tracks t WHERE particle IN (SELECT particle FROM paths WHERE net / nullif(distance, 0) BETWEEN 0.005 AND 0.02 AND distance >= 150)""")
def dynamics_filter_semi(spark, d):
    t = B.tracks(spark, d)
    return T.dynamics_filter(t, T.path_metrics(t, 0.1, 20.0), {"straightness": (0.005, 0.02), "distance_um": (150, None)}).select("particle", "frame", "x")


@query(f"""{B.sql('locs')} SELECT CAST(floor(photons / 100) AS BIGINT) AS bin, count(*) AS n_all, count(*) FILTER (sigma_nm <= 180) AS n_kept FROM locs GROUP BY 1""")
def histogram_all_vs_kept(spark, d):
    return filters.histograms(B.locs(spark, d), "photons", 100, F.col("sigma_nm") <= 180)


PIX = 'CAST(floor((y + 0.5) * 2) AS INTEGER) AS "row", CAST(floor((x + 0.5) * 2) AS INTEGER) AS col'
IN_FIELD = "x < 63.5 AND y < 63.5"


@query(f"""{B.sql('locs')} SELECT {PIX}, CAST(count(*) AS DOUBLE) AS value FROM locs WHERE {IN_FIELD} GROUP BY 1, 2""")
def render_histogram(spark, d):
    return render.histogram(B.locs(spark, d), 64, 64, 2)


@query(f"""{B.sql('locs')} SELECT {PIX}, sum(photons) AS value FROM locs WHERE {IN_FIELD} GROUP BY 1, 2""")
def render_photons(spark, d):
    return render.histogram(B.locs(spark, d), 64, 64, 2, F.col("photons"))


@query(f"""{B.sql('locs')} SELECT DISTINCT {PIX}, 1.0::DOUBLE AS value FROM locs WHERE {IN_FIELD}""")
def render_scatter(spark, d):
    return render.scatter(B.locs(spark, d), 64, 64, 2)


SPLAT = """k AS (SELECT (x + 0.5) * 2 AS fx, (y + 0.5) * 2 AS fy, least(greatest(sigma_nm / 100 / 4 * 2, 0.5), 64 / 3.0) AS s, row_number() OVER () AS id FROM locs),
g AS (SELECT *, CAST(floor(fx) AS INTEGER) AS ix, CAST(floor(fy) AS INTEGER) AS iy, CAST(ceil(s * 3) AS INTEGER) AS r FROM k),
gx AS (SELECT id, ix + d AS c, exp(-power(ix + d + 0.5 - fx, 2) / (2 * s * s)) AS g FROM (SELECT *, unnest(range(-r, r + 1)) AS d FROM g)),
gy AS (SELECT id, iy + d AS r, exp(-power(iy + d + 0.5 - fy, 2) / (2 * s * s)) AS g FROM (SELECT *, unnest(range(-r, r + 1)) AS d FROM g)),
nx AS (SELECT id, c, g / sum(g) OVER (PARTITION BY id) AS g FROM gx), ny AS (SELECT id, r, g / sum(g) OVER (PARTITION BY id) AS g FROM gy)"""


@query(f"""{B.sql('locs')}, {SPLAT} SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, round(sum(nx.g * ny.g), 6) AS value FROM nx JOIN ny USING (id) WHERE r BETWEEN 0 AND 127 AND c BETWEEN 0 AND 127 GROUP BY 1, 2""")
def render_gaussian_local(spark, d):
    return render.splat(B.locs(spark, d), 64, 64, 2, F.col("sigma_nm") / 100 / 4).select("row", "col", R("value"))


MOVIE = f"""{B.sql('locs')}, b AS (SELECT {PIX}, CAST(frame // 300 AS INTEGER) AS movie_frame, CAST(count(*) AS DOUBLE) AS value FROM locs WHERE {IN_FIELD} GROUP BY 1, 2, 3)"""


def _blocks(spark, d):
    l = B.locs(spark, d).withColumn("movie_frame", render.tumbling(F.col("frame"), 0, 300))  # noqa: E741
    return render.histogram(l, 64, 64, 2, by=("movie_frame",))


@query(f"""{MOVIE} SELECT * FROM b""")
def movie_blocks(spark, d):
    return _blocks(spark, d)


@query(f"""{MOVIE}, px AS (SELECT DISTINCT "row", col FROM b), t AS (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS movie_frame)
SELECT px."row", px.col, t.movie_frame, sum(b.value) AS value FROM px, t, b WHERE b."row" = px."row" AND b.col = px.col AND b.movie_frame <= t.movie_frame GROUP BY 1, 2, 3""")
def movie_cumulative(spark, d):
    return render.cumulative(_blocks(spark, d), 4)


@query(f"""{B.sql('locs')}, w AS (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS movie_frame)
SELECT movie_frame, count(*) AS n, sum(photons) AS photons FROM locs, w WHERE frame >= movie_frame * 100 AND frame < movie_frame * 100 + 250 GROUP BY 1""")
def movie_sliding(spark, d):
    return render.sliding(B.locs(spark, d), "frame", 0, 999, 250, 100).groupBy("movie_frame").agg(F.count(F.lit(1)).alias("n"), F.sum("photons").alias("photons"))


@query(f"""{B.sql('walks')}, s AS (SELECT particle, frame, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM walks WINDOW w AS (PARTITION BY particle ORDER BY frame)),
n AS (SELECT *, CAST(greatest(1, ceil(sqrt(power(x1 - x, 2) + power(y1 - y, 2)) / 0.05)) AS INTEGER) AS n FROM s WHERE x1 IS NOT NULL)
SELECT particle, frame, CAST(k AS INTEGER) AS k, round(x + (x1 - x) * k / n, 6) AS x, round(y + (y1 - y) * k / n, 6) AS y FROM (SELECT *, unnest(range(0, n)) AS k FROM n)""")
def trajectory_samples(spark, d):
    return T.resampled(B.walks(spark, d), 0.05).select("particle", "frame", "k", R("x"), R("y"))


@query(f"""{B.sql('walks')}, s AS (SELECT particle, frame, frame - lag(frame) OVER w AS gap, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM walks WINDOW w AS (PARTITION BY particle ORDER BY frame))
SELECT particle, frame, gap, round(dx, 6) AS dx, round(dy, 6) AS dy, round(sqrt(dx * dx + dy * dy), 6) AS length FROM s WHERE gap IS NOT NULL""")
def consecutive_steps(spark, d):
    return T.steps(B.walks(spark, d)).select("particle", "frame", "gap", R("dx"), R("dy"), R("length"))


@query(f"""{B.sql('locs')}, s AS (SELECT DISTINCT frame // 100 AS segment FROM locs) SELECT p.segment AS a, q.segment AS b FROM s p JOIN s q ON p.segment < q.segment""")
def segment_pairs(spark, d):
    return D.segment_pairs(B.locs(spark, d).select(F.floor(F.col("frame") / 100).alias("segment")).distinct())


@query(f"""{B.sql('record')}, s AS (SELECT DISTINCT CAST(floor(t / 37.5) AS BIGINT) AS k FROM record WHERE t % 100 < 40)
SELECT p.k AS a, q.k AS b FROM s AS p JOIN s AS q ON q.k > p.k WHERE q.k - p.k IN (1, 2, 4, 8, 16) OR q.k = (SELECT max(k) FROM s)""")
def lagged_pairs(spark, d):
    """Snapshots at the times of a drift record, with numbers that are missing."""
    s = B.record(spark, d).filter("t % 100 < 40").select(F.floor(F.col("t") / 37.5).alias("snapshot"))
    return D.lagged_pairs(s, [1, 2, 4, 8, 16])


@query(f"""{B.sql('locs')}, i AS (SELECT {PIX}, sum(photons) AS value FROM locs WHERE {IN_FIELD} GROUP BY 1, 2) SELECT 0.0::DOUBLE AS low, round(quantile_cont(value, 0.999), 4) AS high, count(*) AS pixels FROM i WHERE value > 0""")
def contrast_limits(spark, d):
    return render.contrast_limits(render.histogram(B.locs(spark, d), 64, 64, 2, F.col("photons"))).select("low", R("high", places=4), "pixels")


@query(f"""{B.sql('tracks')}, p AS (SELECT particle, (particle * 37 % 101) / 100.0 AS p FROM tracks GROUP BY particle)
SELECT CAST(floor(y) AS INTEGER) AS "row", CAST(floor(x) AS INTEGER) AS col, round(sum(p), 6) AS immobile, round(sum(1 - p), 6) AS mobile FROM tracks JOIN p USING (particle) GROUP BY 1, 2""")
def soft_population_weights(spark, d):
    t = B.tracks(spark, d)
    p = t.select("particle").distinct().select("particle", (F.col("particle") * 37 % 101 / 100.0).alias("p_immobile")).withColumn("p_1", 1 - F.col("p_immobile"))
    met = selection.attach_population(t, p).withColumn("x", F.col("x") - 0.5).withColumn("y", F.col("y") - 0.5)
    each = [render.histogram(met, 64, 64, 1, selection.soft_weights(met, c)).select("row", "col", R("value", name)) for c, name in (("p_immobile", "immobile"), ("p_1", "mobile"))]
    return each[0].join(each[1], ["row", "col"])


COEF = [(32.5, 31.0), (30.2, 0.4), (-0.3, 29.5), (0.8, 0.1), (0.2, -0.5), (-0.1, 0.6)]


def _quad_sql() -> str:
    terms = ["1", "u", "v", "u * u", "u * v", "v * v"]
    x, y = (" + ".join(f"({c[k]}) * {t}" for t, c in zip(terms, COEF, strict=True)) for k in (0, 1))
    return f"""{B.sql('locs')}, n AS (SELECT frame, x, y, (x - 32) / 30 AS u, (y - 32) / 30 AS v FROM locs)
SELECT frame, x, y, round({x} + 1.23e-8, 6) AS mx, round({y} + 1.23e-8, 6) AS my, round((30.2 + 1.6 * u + 0.2 * v) / 30, 6) AS jxx, round((-0.3 + 0.2 * u - 0.2 * v) / 30, 6) AS jxy,
round((0.4 + 0.2 * u - 0.5 * v) / 30, 6) AS jyx, round((29.5 - 0.5 * u + 1.2 * v) / 30, 6) AS jyy FROM n"""


@query(_quad_sql())
def quad_map_apply(spark, d):
    x, y = F.col("x"), F.col("y")
    mx, my = S.quad_map(x, y, COEF, (32, 32), 30)
    j = S.quad_jacobian(x, y, COEF, (32, 32), 30)
    return B.locs(spark, d).select("frame", "x", "y", R(mx + 1.23e-8, "mx"), R(my + 1.23e-8, "my"), R(j[0], "jxx"), R(j[1], "jxy"), R(j[2], "jyx"), R(j[3], "jyy"))


PATCH = "px AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c, CAST(embedding[i + 1] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings))"


@query(f"""WITH {PATCH} SELECT a.vec_id, a.r, a.c FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c)
WHERE a.r BETWEEN 2 AND 5 AND a.c BETWEEN 2 AND 5 GROUP BY 1, 2, 3 HAVING bool_and(CASE WHEN b.r < a.r OR (b.r = a.r AND b.c < a.c) THEN a.v > b.v ELSE a.v >= b.v END)""")
def local_maxima_patch(spark, d):
    """Those a box and a pixel away from the edge, as the operator finds them."""

    def run(batches):
        for f in batches:
            out = [(k, r, c) for k, b in zip(f["frame"], f["pixels"], strict=True) for r, c in zip(*spots.local_maxima(np.frombuffer(b, np.float64).reshape(8, 8), 3), strict=True)]
            yield pd.DataFrame(out, columns=["vec_id", "r", "c"])

    return _patches(spark, d).select("frame", "pixels").mapInPandas(run, "vec_id long, r int, c int")


@query(f"""WITH {PATCH}, g AS (SELECT p.vec_id, p.r - 3 AS dy, p.c - 3 AS dx, d.v - u.v AS gy, r.v - l.v AS gx FROM px p JOIN px u ON u.vec_id = p.vec_id AND u.r = p.r - 1 AND u.c = p.c
JOIN px d ON d.vec_id = p.vec_id AND d.r = p.r + 1 AND d.c = p.c JOIN px l ON l.vec_id = p.vec_id AND l.r = p.r AND l.c = p.c - 1 JOIN px r ON r.vec_id = p.vec_id AND r.r = p.r AND r.c = p.c + 1
WHERE p.r BETWEEN 1 AND 5 AND p.c BETWEEN 1 AND 5 AND NOT (p.r = 3 AND p.c = 3))
SELECT vec_id, round(-sum((gy * dy + gx * dx) / sqrt(dy * dy + dx * dx)), 5) AS net_gradient FROM g GROUP BY vec_id""")
def net_gradient_patch(spark, d):
    centre = np.array([3])

    def run(batches):
        for f in batches:
            yield pd.DataFrame({"vec_id": f["frame"].astype("int64"), "g": [float(spots.net_gradient(np.frombuffer(b, np.float64).reshape(8, 8), centre, centre, 5)[0]) for b in f["pixels"]]})

    return _patches(spark, d).select("frame", "pixels").mapInPandas(run, "vec_id long, g double").select("vec_id", R("g", "net_gradient", 5))


@query(f"""{B.sql('tracks')}, {PATHS} SELECT particle, round(least(greatest((ln(nullif(greatest(net, 0), 0)) - ln(0.1)) / (ln(10) - ln(0.1)), 0), 1), 6) AS log_scale, round(least(greatest(distance / 400, 0), 1), 6) AS linear_scale,
CASE WHEN duration < 60 THEN CAST(floor(duration) AS BIGINT) || ' s' END AS shown FROM paths""")
def metric_scales(spark, d):
    m = T.path_metrics(B.tracks(spark, d), 0.1, 20.0)
    return m.select("particle", R(S.normalised(F.col("net_displacement_um"), F.lit(0.1), F.lit(10.0), True), "log_scale"), R(S.normalised(F.col("distance_um"), F.lit(0.0), F.lit(400.0)), "linear_scale"),
                    F.when(F.col("duration_s") < 60, S.time_label(F.col("duration_s"), F.lit(10.0))).alias("shown"))
