"""More registered queries: windows, attachments, linking, image arithmetic, fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from glimmer.functions import scalars as S
from glimmer.operators import drift as D
from glimmer.operators import growth, link, populations, register, render, selection, spots
from glimmer.operators import tracks as T
from glimmer.plans import bridge as B
from glimmer.plans.catalog import FIT, IN_FIELD, PIX, R, query


@query(f"{B.sql('walks')} SELECT particle, min(frame) AS first_frame, max(frame) AS last_frame FROM walks GROUP BY particle")
def trajectory_time_metric(spark, d):
    return T.time_span(B.walks(spark, d))


@query(f"{B.sql('walks')} SELECT particle, frame, x FROM walks WHERE frame <= 40 AND frame > 28")
def trajectory_trail(spark, d):
    return T.trail(B.walks(spark, d), 40, 12).select("particle", "frame", "x")


@query(f"""{B.sql('tracks')}, odd AS (SELECT frame, x, y, min(particle) AS particle FROM tracks WHERE particle % 2 = 1 GROUP BY frame, x, y)
SELECT t.frame, round(t.x * 100, 4) AS x_nm, coalesce(o.particle, -1) AS particle FROM tracks t LEFT JOIN odd o ON o.frame = t.frame AND o.x = t.x AND o.y = t.y""")
def localization_attach(spark, d):
    t = B.tracks(spark, d)
    locs = t.select("frame", (F.col("x") * 100).alias("x_nm"), (F.col("y") * 100).alias("y_nm"))
    return T.attach_trajectory(locs, t.filter("particle % 2 = 1"), 100.0).select("frame", R("x_nm", places=4), "particle")


@query(f"""{B.sql('locs')}, f AS (SELECT frame, avg(photons) AS dx, avg(sigma_nm) AS dy, bool_or(x > 63) AS outside FROM locs GROUP BY frame)
SELECT CAST(frame // 8 AS INTEGER) AS frame, round(avg(dx), 6) AS dx, round(avg(dy), 6) AS dy, bool_or(outside) AS outside FROM f GROUP BY 1""")
def drift_binned_mean(spark, d):
    f = B.locs(spark, d).groupBy("frame").agg(F.avg("photons").alias("dx"), F.avg("sigma_nm").alias("dy"), F.bool_or(F.col("x") > 63).alias("outside"))
    return D.binned_drift(f, 8).select("frame", R("dx"), R("dy"), "outside")


@query(f"""{B.sql('locs')}, f AS (SELECT frame, avg(x) AS dx, avg(y) AS dy FROM locs WHERE frame < 900 GROUP BY frame)
SELECT l.frame, round(l.x * 100 - f.dx + 1.23e-8, 6) AS x_nm, round(l.y * 100 - f.dy + 1.23e-8, 6) AS y_nm, l.frame > 899 AS outside FROM locs l LEFT JOIN f ON f.frame = least(l.frame, 899)""")
def drift_corrected(spark, d):
    l = B.locs(spark, d).select("frame", (F.col("x") * 100).alias("x_nm"), (F.col("y") * 100).alias("y_nm"), "x", "y")  # noqa: E741
    f = l.filter("frame < 900").groupBy("frame").agg(F.avg("x").alias("dx"), F.avg("y").alias("dy"))
    return D.corrected(l.drop("x", "y"), f, 900).select("frame", R(F.col("x_nm") + 1.23e-8, "x_nm"), R(F.col("y_nm") + 1.23e-8, "y_nm"), "outside")


SIGMA, GRID = 50.0, 10.0
_REACH = int(4 * SIGMA / GRID + 0.5)


@query(f"""{B.sql('record')}, z AS (SELECT min(t) AS t0, max(t) AS t1 FROM record),
b AS (SELECT t0, t1, CAST(round((t - t0) / {GRID}) AS BIGINT) AS k, count(*) * 1.0 AS s0, sum((t - t0) / {GRID}) AS s1, sum(power((t - t0) / {GRID}, 2)) AS s2, sum(dx) AS x0, sum((t - t0) / {GRID} * dx) AS x1 FROM record, z GROUP BY 1, 2, 3),
g AS (SELECT d, exp(-d * d / 50.0) AS v FROM (SELECT unnest(range(-{_REACH}, {_REACH + 1})) AS d)),
w AS (SELECT t0, t1, k + d AS k, sum(s0 * v) / any_value(n) AS s0, sum(s1 * v) / any_value(n) AS s1, sum(s2 * v) / any_value(n) AS s2, sum(x0 * v) / any_value(n) AS x0, sum(x1 * v) / any_value(n) AS x1
 FROM b, g, (SELECT sum(v) AS n FROM g) GROUP BY 1, 2, 3)
SELECT k, round((s2 * x0 - s1 * x1) / (s0 * s2 - s1 * s1) + (s0 * x1 - s1 * x0) / (s0 * s2 - s1 * s1) * k, 5) AS dx
FROM w WHERE k >= 0 AND t0 + k * {GRID} <= t1 + {GRID} AND s0 >= 1e-3 AND s0 * s2 - s1 * s1 > 1e-9 * greatest(s0 * s2, 1e-30)""")
def drift_smoothed(spark, d):
    return D.smoothed(B.record(spark, d), SIGMA, GRID).filter("dx IS NOT NULL").select("k", R("dx", places=5))


@query(f"""{B.sql('record')}, r AS (SELECT * FROM record WHERE t < 2000 OR t > 8000 OR t % 1000 = 0), z AS (SELECT min(t) AS t0, max(t) AS t1 FROM r),
b AS (SELECT t0, CAST(round((t - t0) / {GRID}) AS BIGINT) AS k, count(*) * 1.0 AS s0, sum((t - t0) / {GRID}) AS s1, sum(power((t - t0) / {GRID}, 2)) AS s2, sum(dx) AS x0, sum((t - t0) / {GRID} * dx) AS x1 FROM r, z GROUP BY 1, 2),
g AS (SELECT d, exp(-d * d / 50.0) AS v FROM (SELECT unnest(range(-{_REACH}, {_REACH + 1})) AS d)),
w AS (SELECT k + d AS k, sum(s0 * v) / any_value(n) AS s0, sum(s1 * v) / any_value(n) AS s1, sum(s2 * v) / any_value(n) AS s2, sum(x0 * v) / any_value(n) AS x0, sum(x1 * v) / any_value(n) AS x1
 FROM b, g, (SELECT sum(v) AS n FROM g) GROUP BY 1),
f AS (SELECT k, (s2 * x0 - s1 * x1) / (s0 * s2 - s1 * s1) + (s0 * x1 - s1 * x0) / (s0 * s2 - s1 * s1) * k AS dx FROM w WHERE s0 >= 1e-3 AND s0 * s2 - s1 * s1 > 1e-9 * greatest(s0 * s2, 1e-30)),
e AS (SELECT k, t0 + k * {GRID} AS te FROM (SELECT t0, unnest(range(0, CAST(floor((t1 - t0) / {GRID}) AS BIGINT) + 2)) AS k FROM z)),
i AS (SELECT e.k AS k, e.te AS te, arg_max(a.dx, a.t) AS xa, max(a.t) AS ta FROM e LEFT JOIN r AS a ON a.t <= e.te GROUP BY 1, 2),
j AS (SELECT i.*, (SELECT min(t) FROM r WHERE t > i.te) AS tb FROM i)
SELECT j.k AS k, round(coalesce(f.dx, CASE WHEN tb IS NULL THEN xa ELSE xa + (r.dx - xa) * (te - ta) / (tb - ta) END) + 1.23e-7, 5) AS dx, f.dx IS NULL AS thin
FROM j LEFT JOIN f ON f.k = j.k LEFT JOIN r ON r.t = j.tb""")
def drift_smoothed_thin(spark, d):
    """A record with lone samples between two dense runs: thin windows follow the samples."""
    r = B.record(spark, d).filter("t < 2000 OR t > 8000 OR t % 1000 = 0")
    lone = D.smoothed(r, 0.0, GRID).withColumnRenamed("dx", "raw").select("k", "raw")
    return D.smoothed(r, SIGMA, GRID).join(lone, "k").select("k", R(F.col("dx") + 1.23e-7, "dx", 5), (F.abs(F.col("dx") - F.col("raw")) < 1e-12).alias("thin"))


@query(f"""{B.sql('locs')}, s AS (SELECT frame // 200 AS segment, avg(frame) + 7 AS centre, avg(x) AS dx, avg(y) AS dy FROM locs GROUP BY 1),
l AS (SELECT *, row_number() OVER (ORDER BY centre) AS i, (lead(dx) OVER (ORDER BY centre) - dx) / (lead(centre) OVER (ORDER BY centre) - centre) AS gx,
  (lead(dy) OVER (ORDER BY centre) - dy) / (lead(centre) OVER (ORDER BY centre) - centre) AS gy FROM s),
f AS (SELECT DISTINCT frame FROM locs), z AS (SELECT max(i) - 1 AS last FROM l),
c AS (SELECT frame, greatest(1, least((SELECT last FROM z), (SELECT count(*) FROM l WHERE centre <= frame))) AS i FROM f)
SELECT frame, round(l.dx + gx * (frame - centre) - (SELECT dx - gx * centre FROM l WHERE i = 1) + 1.23e-8, 6) AS dx,
       round(l.dy + gy * (frame - centre) - (SELECT dy - gy * centre FROM l WHERE i = 1) + 1.23e-8, 6) AS dy
FROM c JOIN l USING (i)""")
def rcc_curve_per_frame(spark, d):
    """The curve through segment drifts, zero at the first frame."""
    l = B.locs(spark, d)  # noqa: E741
    s = l.groupBy(F.floor(F.col("frame") / 200).alias("segment")).agg((F.avg("frame") + 7).alias("centre"), F.avg("x").alias("dx"), F.avg("y").alias("dy"))
    return D.rcc_per_frame(l.select("frame").distinct(), s).select("frame", R(F.col("dx") + 1.23e-8, "dx"), R(F.col("dy") + 1.23e-8, "dy"))


_POINTS = """pts AS (SELECT particle, frame, event_id AS loc, x + (particle % 50) * 20 AS x, y + (particle // 50) * 20 AS y FROM (
  SELECT user_id AS particle, event_id, CAST(row_number() OVER w - 1 + sum(CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS frame,
         sum((event_id * 7919) % 201 - 100) OVER w / 1000.0 AS x, sum((event_id * 104729) % 201 - 100) OVER w / 1000.0 AS y
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)))"""


def _points(spark, d):
    e = B.table(spark, d, "events")
    run = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    i = F.col("event_id")
    frame = F.count(F.lit(1)).over(run) - 1 + F.sum(F.when(i % 17 == 0, 1).otherwise(0)).over(run)
    x, y = ((F.sum((i * k) % 201 - 100).over(run) / 1000.0) for k in (7919, 104729))
    return e.select((F.col("user_id") % 50).alias("acquisition"), i.alias("loc"), frame.alias("frame"), (x + F.col("user_id") % 50 * 20).alias("x"), (y + F.floor(F.col("user_id") / 50) * 20).alias("y"))


@query(f"""WITH {_POINTS}, s AS (SELECT *, CASE WHEN frame - lag(frame) OVER w = 1 THEN 0 ELSE 1 END AS new FROM pts WINDOW w AS (PARTITION BY particle ORDER BY frame)),
r AS (SELECT *, sum(new) OVER (PARTITION BY particle ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT loc, frame, first_value(loc) OVER (PARTITION BY particle, run ORDER BY frame) AS particle FROM r""")
def link_consecutive(spark, d):
    return link.link(_points(spark, d), 1.0).select("loc", "frame", "particle")


@query(f"""WITH {_POINTS} SELECT loc, frame, first_value(loc) OVER (PARTITION BY particle ORDER BY frame) AS particle FROM pts""")
def link_with_memory(spark, d):
    return link.link(_points(spark, d), 1.0, memory=1, by=("acquisition",)).select("loc", "frame", "particle")


@query(f"""WITH {_POINTS} SELECT a.loc AS a, b.loc AS b, round(power(a.x - b.x, 2) + power(a.y - b.y, 2), 6) AS sq FROM pts a JOIN pts b ON b.frame = a.frame + 1 AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 1""")
def spatial_range_join(spark, d):
    return link.candidates(_points(spark, d), 1.0).select("a", "b", R("sq"))


def _crowded_sql(frames: int = 6) -> str:
    """The frame-by-frame order as one step a frame: at most two points of a cell are in a frame, so
    the best links of a step are one candidate or two that share no point."""
    steps = ["""p AS (
  SELECT event_id AS loc, user_id * 1000 + i // 12 AS cell, i % 12 // 2 AS frame, ((event_id * 7919) % 1999993) / 1000003.0 AS x, ((event_id * 104729) % 1999979) / 1000003.0 AS y
  FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events) WHERE event_id % 5 <> 0),
l0 AS (SELECT loc AS a, loc AS b, cell FROM p WHERE false)"""]
    for k in range(1, frames):
        steps.append(f"""e{k} AS (
  SELECT b.cell AS cell, a.loc AS a, b.loc AS b, 1 - power(a.x - b.x, 2) - power(a.y - b.y, 2) AS gain
  FROM p AS a JOIN p AS b USING (cell)
  WHERE b.frame = {k} AND (a.frame = {k - 1} OR a.frame = {k - 2} AND a.loc NOT IN (SELECT a FROM l{k - 1})) AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 1),
o{k} AS (
  SELECT cell, a, b, NULL::BIGINT AS a2, NULL::BIGINT AS b2, gain FROM e{k}
  UNION ALL SELECT e.cell, e.a, e.b, f.a, f.b, e.gain + f.gain FROM e{k} AS e JOIN e{k} AS f ON e.cell = f.cell AND e.b < f.b AND e.a <> f.a),
best{k} AS (SELECT * FROM o{k} QUALIFY row_number() OVER (PARTITION BY cell ORDER BY gain DESC) = 1),
l{k} AS (SELECT a, b, cell FROM best{k} UNION ALL SELECT a2, b2, cell FROM best{k} WHERE a2 IS NOT NULL)""")
    every = " UNION ALL ".join(f"SELECT a, b FROM l{k}" for k in range(1, frames))
    return f"""WITH RECURSIVE {", ".join(steps)}, links AS ({every}),
r AS (SELECT loc, loc AS particle FROM p WHERE loc NOT IN (SELECT b FROM links) UNION ALL SELECT l.b, r.particle FROM r JOIN links AS l ON l.a = r.loc)
SELECT loc, particle FROM r"""


@query(_crowded_sql())
def link_crowded_with_gaps(spark, d):
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1
    e = B.table(spark, d, "events").select("event_id", "user_id", i.alias("i")).filter("event_id % 5 <> 0")
    points = e.select(
        F.col("event_id").alias("loc"), (F.col("user_id") * 1000 + F.floor(F.col("i") / 12)).alias("cell"), F.floor(F.col("i") % 12 / 2).alias("frame"),
        (F.col("event_id") * 7919 % 1999993 / 1000003.0).alias("x"), (F.col("event_id") * 104729 % 1999979 / 1000003.0).alias("y"),
    )
    return link.link(points, 1.0, memory=1, by=("cell",)).select("loc", "particle")


@query(f"""{B.sql('locs')}, i AS (SELECT {PIX}, count(*) AS value FROM locs WHERE {IN_FIELD} GROUP BY 1, 2)
SELECT 127 - col AS "row", "row" AS col, CAST(least(greatest(floor(value / 40.0 * 255), 0), 255) AS INTEGER) AS shown FROM i WHERE "row" BETWEEN 10 AND 99""")
def image_rotate_crop_stretch(spark, d):
    i = render.cropped(render.histogram(B.locs(spark, d), 64, 64, 2), 10, 100, 0, 128)
    return render.rotated(i, 1, 128, 128).select("row", "col", S.eight_bit(F.col("value"), F.lit(0.0), F.lit(40.0)).alias("shown"))


@query(f"""{B.sql('locs')}, l AS (SELECT {PIX}, CAST(photons % 7 AS INTEGER) AS r, CAST(frame % 8 AS INTEGER) AS g, 1 AS b FROM locs WHERE {IN_FIELD})
SELECT "row", col, CAST(least(sum(r), 255) AS INTEGER) AS r, CAST(least(sum(g), 255) AS INTEGER) AS g, CAST(least(sum(b), 255) AS INTEGER) AS b FROM l GROUP BY 1, 2""")
def additive_blend(spark, d):
    l = render.binned(B.locs(spark, d), 64, 64, 2)  # noqa: E741
    return render.blended(l.select("row", "col", (F.col("photons") % 7).cast("int").alias("r"), (F.col("frame") % 8).cast("int").alias("g"), F.lit(1).alias("b")))


_G = [math.exp(-k * k / 2) for k in range(-3, 4)]


@query(f"""{B.sql('locs')}, i AS (SELECT {PIX}, count(*) AS value FROM locs WHERE {IN_FIELD} GROUP BY 1, 2),
g AS (SELECT d, exp(-d * d / 2.0) / {sum(_G)!r} AS v FROM (SELECT unnest(range(-3, 4)) AS d)),
a AS (SELECT "row", CASE WHEN (col + d + 256) % 256 < 128 THEN (col + d + 256) % 256 ELSE 255 - (col + d + 256) % 256 END AS col, sum(value * v) AS value FROM i, g GROUP BY 1, 2),
c AS (SELECT CASE WHEN ("row" + d + 256) % 256 < 128 THEN ("row" + d + 256) % 256 ELSE 255 - ("row" + d + 256) % 256 END AS "row", col, sum(value * v) AS value FROM a, g GROUP BY 1, 2)
SELECT CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, round(value, 6) AS value FROM c""")
def render_global_blur(spark, d):
    out = render.blurred(render.histogram(B.locs(spark, d), 64, 64, 2), 1.0, 128, 128)
    return out.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), R("value"))


@query(f"""{B.sql('record')} SELECT t, round(regr_slope(dx, t) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS rate FROM record""")
def sliding_slope(spark, d):
    return register.growth_metrics(B.record(spark, d).select("t", F.col("dx").alias("stretch"))).select("t", R("rate"))


_QUAD = growth.QuadMap([(32.5, 31.0), (30.2, 0.4), (-0.3, 29.5), (0.8, 0.1), (0.2, -0.5), (-0.1, 0.6)], (32.0, 32.0), 30.0)


@query(f"""{B.sql('locs')}, n AS (SELECT frame, x, y, (1.02 * x - 0.03 * y + 0.5 - 32) / 30 AS u, (0.05 * x + 0.97 * y - 0.25 - 32) / 30 AS v FROM locs),
m AS (SELECT frame, x, y, 32.5 + 30.2 * u - 0.3 * v + 0.8 * u * u + 0.2 * u * v - 0.1 * v * v - 0.5 AS a, 31.0 + 0.4 * u + 29.5 * v + 0.1 * u * u - 0.5 * u * v + 0.6 * v * v + 0.25 AS b FROM n)
SELECT frame, x, y, round((0.97 * a + 0.03 * b) / (1.02 * 0.97 + 0.03 * 0.05), 6) AS fx, round((-0.05 * a + 1.02 * b) / (1.02 * 0.97 + 0.03 * 0.05), 6) AS fy FROM m""")
def growth_final_position(spark, d):
    fx, fy = growth.final_position(F.col("x"), F.col("y"), _QUAD, (1.02, -0.03, 0.05, 0.97), (0.5, -0.25))
    return B.locs(spark, d).select("frame", "x", "y", R(fx, "fx"), R(fy, "fy"))


_MIX = populations.Mixture(np.array([0.001, 0.08]), np.array([0.35, 0.65]), 0.0)
_V = [float(2 * v * 0.03 * (1 - 2 / 6) + 2 * 0.02**2) for v in _MIX.d]


@query(f"""{B.sql('walks')}, s AS (SELECT particle, frame - lag(frame) OVER w AS gap, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS r FROM walks WINDOW w AS (PARTITION BY particle ORDER BY frame)),
o AS (SELECT r FROM s WHERE gap = 1), c AS (SELECT b, (b + 0.5) * 0.01 AS m FROM (SELECT unnest(range(0, 15)) AS b)), n AS (SELECT count(*) AS n FROM o)
SELECT CAST(c.b AS BIGINT) AS bin, round(coalesce(k.k, 0) / (n.n * 0.01), 6) AS observed, round(0.35 * m / {_V[0]!r} * exp(-m * m / (2 * {_V[0]!r})) + 0.65 * m / {_V[1]!r} * exp(-m * m / (2 * {_V[1]!r})), 6) AS predicted
FROM c CROSS JOIN n LEFT JOIN (SELECT floor(r / 0.01) AS b, count(*) AS k FROM o GROUP BY 1) k ON k.b = c.b""")
def step_length_densities(spark, d):
    """Observed one-frame step lengths against those of a mixture; bins are a parameter, not data."""
    s = T.steps(B.walks(spark, d)).filter("gap = 1")
    counts = s.groupBy(F.floor(F.col("length") / 0.01).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    n = s.agg(F.count(F.lit(1)).alias("n"))
    bins = spark.range(15).withColumnRenamed("id", "bin").join(counts, "bin", "left").crossJoin(F.broadcast(n))  # one row
    shown = populations.step_density(bins.withColumn("length", (F.col("bin") + 0.5) * 0.01), _MIX, 0.02, 0.03)
    return shown.select("bin", R(F.coalesce("k", F.lit(0)) / (F.col("n") * 0.01), "observed"), R("predicted"))


@query(f"""{B.sql('walks')}, z AS (SELECT particle, frame - lag(frame) OVER w AS gap, 1000 * sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS r, power(sigma, 2) + power(lag(sigma) OVER w, 2) AS s
  FROM walks WINDOW w AS (PARTITION BY particle ORDER BY frame)),
o AS (SELECT r, s, (particle % 7) / 8.0 AS p, (particle % 3 + 1) / 4.0 * (1 - (particle % 7) / 8.0) AS q FROM z WHERE gap = 1),
c AS (SELECT unnest(range(0, 30)) AS bin), k AS (SELECT floor(r / 5.03) AS bin, count(*) AS k FROM o WHERE r < 150.9 GROUP BY 1),
d AS (SELECT c.bin AS bin, sum(p * m / (s + {2.0e6 * 0.0005 * 0.03 * (1 - 2 / 6)!r}) * exp(-m * m / (2 * (s + {2.0e6 * 0.0005 * 0.03 * (1 - 2 / 6)!r})))) / count(*) AS a,
  sum(q * m / (s + {2.0e6 * 0.05 * 0.03 * (1 - 2 / 6)!r}) * exp(-m * m / (2 * (s + {2.0e6 * 0.05 * 0.03 * (1 - 2 / 6)!r})))) / count(*) AS b,
  sum((1 - p - q) * m / (s + {2.0e6 * 0.4 * 0.03 * (1 - 2 / 6)!r}) * exp(-m * m / (2 * (s + {2.0e6 * 0.4 * 0.03 * (1 - 2 / 6)!r})))) / count(*) AS e
  FROM o, (SELECT bin, (bin + 0.5) * 5.03 AS m FROM c) AS c GROUP BY 1)
SELECT bin, round(coalesce(k, 0) / ((SELECT sum(k) FROM k) * 5.03), 9) AS observed, round(a, 9) AS predicted_0, round(b, 9) AS predicted_1, round(e, 9) AS predicted_2 FROM d LEFT JOIN k USING (bin)""")
def step_lengths_by_population(spark, d):
    """Observed step lengths, and the curve of each of three populations weighted by posteriors."""
    w = B.walks(spark, d).select("particle", "frame", (F.col("x") * 1000).alias("x_nm"), (F.col("y") * 1000).alias("y_nm"), F.col("sigma").alias("sigma_nm"))
    p, q = F.col("particle") % 7 / 8.0, (F.col("particle") % 3 + 1) / 4.0 * (1 - F.col("particle") % 7 / 8.0)
    post = w.select("particle").distinct().select("particle", p.alias("p_immobile"), q.alias("p_1"), (1 - p - q).alias("p_2"))
    out = populations.step_densities(populations.increments(w), post, [0.0005, 0.05, 0.4], 0.03, 5.03, 30)
    return out.select("bin", *[R(c, places=9) for c in ("observed", "predicted_0", "predicted_1", "predicted_2")])


@query(f"""{B.sql('tracks')}, p AS (SELECT particle, (particle % 10) / 10.0 AS p_immobile, count(*) AS n_points FROM tracks GROUP BY particle)
SELECT round(sum(n_points * p_immobile) / sum(n_points), 9) AS p_immobile, round(avg(p_immobile), 9) AS by_trajectory FROM p""")
def localization_fractions(spark, d):
    p = B.tracks(spark, d).groupBy("particle").agg(F.count(F.lit(1)).alias("n_points")).withColumn("p_immobile", F.col("particle") % 10 / 10.0)
    mean = p.agg(R(F.avg("p_immobile"), "by_trajectory", 9))
    return populations.localization_fraction(p).select(R("p_immobile", places=9)).crossJoin(mean)  # one row each


@query(f"""{B.sql('tracks')}, p AS (SELECT particle, (particle % 10) / 10.0 AS p_immobile FROM tracks WHERE particle % 3 > 0 GROUP BY particle)
SELECT t.particle, frame, p_immobile, CASE WHEN p_immobile >= 0.7 THEN 'immobile' WHEN 1 - p_immobile >= 0.7 THEN 'mobile' ELSE 'undetermined' END AS class FROM tracks t LEFT JOIN p ON p.particle = t.particle""")
def population_attach(spark, d):
    t = B.tracks(spark, d)
    p = t.filter("particle % 3 > 0").select("particle").distinct().withColumn("p_immobile", F.col("particle") % 10 / 10.0)
    return T.classify_by_fit(selection.attach_population(t, p), 0.7).select("particle", "frame", "p_immobile", "class")


@query(f"""{B.sql('locs')} SELECT CAST(frame // 100 AS INTEGER) - 2 AS movie_frame, 99 + ((frame // 100) - 2) * 100 + 200 AS shown_at, count(*) AS n FROM locs WHERE frame BETWEEN 200 AND 799 GROUP BY 1, 2""")
def movie_fixed_range(spark, d):
    l = render.fixed_range(B.locs(spark, d), "frame", 200, 799).withColumn("movie_frame", render.tumbling(F.col("frame"), 200, 100))  # noqa: E741
    return l.groupBy("movie_frame", render.window_close(F.col("movie_frame").cast("long"), 200, 100, 100).alias("shown_at")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{B.sql('locs')} SELECT frame FROM locs WHERE frame BETWEEN 100 AND 700 AND (frame - 100) % 50 = 0 GROUP BY frame""")
def movie_stride(spark, d):
    return render.strided(B.locs(spark, d), "frame", 100, 700, 50).select("frame").distinct()


@query(f"""{FIT}, m AS (SELECT particle, median(sigma) AS s, count(*) AS n FROM walks GROUP BY particle),
j AS (SELECT m.particle, s, n, CASE WHEN intercept > 0 THEN sqrt(intercept) / 2 * 1000 END AS shown FROM m LEFT JOIN f USING (particle))
SELECT particle, round(s, 6) AS sigma_fit, n, round(shown, 3) AS sigma_msd, round(shown / s, 5) AS ratio FROM j""")
def precision_per_trajectory(spark, d):
    w = B.walks(spark, d)
    told = T.precision_check(w, T.msd_fit(T.msd(w, 5, 0.1), 0.03), F.col("sigma"))
    return told.select("particle", R("sigma_fit"), "n", R("sigma_msd", places=3), R("ratio", places=5))


@query(f"""WITH {_POINTS} SELECT a.loc AS a, b.loc AS b, b.frame - a.frame AS gap, round(power(a.x - b.x, 2) + power(a.y - b.y, 2), 6) AS sq
FROM pts a JOIN pts b ON b.frame BETWEEN a.frame + 1 AND a.frame + 3 AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 1""")
def spatial_range_join_with_memory(spark, d):
    return link.candidates(_points(spark, d), 1.0, memory=2).select("a", "b", "gap", R("sq"))


@query()
def population_fit(spark, d):
    w = B.walks(spark, d).select("particle", "frame", (F.col("x") * 1000).alias("x_nm"), (F.col("y") * 1000).alias("y_nm"), F.col("sigma").alias("sigma_nm"))
    _, post = populations.fit_populations(w, 0.03)  # one mobile population or two, by BIC
    return post


@query()
def spot_fit_patches(spark, d):
    """Least-squares fits of the embeddings; a patch has a centre, so the last row and column of 8 are left out."""

    def run(batches):
        for f in batches:
            p = np.stack(f["embedding"]).reshape(-1, 8, 8)[:, :7, :7].astype(float)
            t, ok = spots.fit(p - p.min((1, 2), keepdims=True))
            yield pd.DataFrame({"vec_id": f["vec_id"], "x": t[:, 2], "y": t[:, 3], "sx": t[:, 4], "sy": t[:, 5], "ok": ok})

    return B.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, x double, y double, sx double, sy double, ok boolean")


@query()
def rcc_drift(spark, d):
    l = B.locs(spark, d).select("frame", (F.col("x") * 100).alias("x_nm"), (F.col("y") * 100).alias("y_nm"))  # noqa: E741
    return D.rcc(l, 1000, 250, 50.0, 50.0, 400.0, 30.0)
