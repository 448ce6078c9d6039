"""More registered queries.  Scans and sinks: what Spark makes of the given tables is written by a
sink into a new folder under ``spark.checkpoint.dir``, and read back by the scan.  Views: layers
on one grid.  Spots: where fits begin."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from glimmer.operators import compose, spots
from glimmer.plans import bridge as B
from glimmer.plans.catalog import PATCH, R, _patches, _pixel_sum, query
from glimmer.session import shared_dir
from glimmer.sources import stack


@query("""SELECT CAST(vec_id AS INTEGER) AS frame, 8 AS height, 8 AS width, round(list_sum(CAST(embedding AS DOUBLE[])) + 1.23e-8, 5) AS total FROM embeddings""")
def stack_written_and_read(spark, d):
    folder = f"{shared_dir(spark)}/stack-{uuid.uuid4().hex}"
    stack.write_stack(_patches(spark, d), folder, per_file=400)
    return stack.stack(spark, folder).select("frame", "height", "width", R(_pixel_sum("pixels") + F.lit(1.23e-8), "total", 5))


@query("""SELECT CAST(vec_id // 400 AS INTEGER) AS file, count(*) AS pages, CAST(min(vec_id % 400) AS INTEGER) AS first_page, CAST(max(vec_id % 400) AS INTEGER) AS last_page, '<f4' AS dtype, 256 AS page_bytes
FROM embeddings GROUP BY 1""")
def stack_page_index(spark, d):
    folder = f"{shared_dir(spark)}/stack-{uuid.uuid4().hex}"
    stack.write_stack(_patches(spark, d), folder, per_file=400, deflated=False)
    index = stack.page_index(spark, folder)
    file = F.regexp_extract("path", r"frames_(\d+)\.tif$", 1).cast("int")
    g = index.groupBy(file.alias("file"), "dtype", F.col("sizes")[0].cast("int").alias("page_bytes"))
    return g.agg(F.count(F.lit(1)).alias("pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query(f"""WITH {PATCH}, b AS (SELECT vec_id, list_sort(CAST(embedding AS DOUBLE[]))[7] AS floor, list_max(CAST(embedding AS DOUBLE[])) AS top FROM embeddings),
s AS (SELECT vec_id, r, c, greatest(v - floor, 0) AS w, floor, top FROM px JOIN b USING (vec_id)),
m AS (SELECT vec_id, any_value(floor) AS floor, any_value(top) AS top, sum(w * c) / sum(w) AS x, sum(w * r) / sum(w) AS y FROM s GROUP BY vec_id),
v AS (SELECT vec_id, sum(w * power(c - x, 2)) / sum(w) AS vx, sum(w * power(r - y, 2)) / sum(w) AS vy FROM s JOIN m USING (vec_id) GROUP BY vec_id)
SELECT vec_id, round(greatest(top - floor, 1), 6) AS height, round(floor, 6) AS background, round(x, 6) AS x, round(y, 6) AS y, round(sqrt(greatest(vx, 0.5)), 6) AS sx, round(sqrt(greatest(vy, 0.5)), 6) AS sy
FROM m JOIN v USING (vec_id)""")
def spot_moments(spark, d):
    """Where the fits of the embeddings, as patches of 8 x 8 pixels, begin."""
    names = ["height", "background", "x", "y", "sx", "sy"]

    def run(batches):
        for f in batches:
            t = spots.guess(np.stack(f["embedding"]).reshape(-1, 8, 8).astype(float))
            yield pd.DataFrame(t, columns=names).assign(vec_id=f["vec_id"])

    schema = ", ".join(f"{n} double" for n in names) + ", vec_id long"
    return B.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, schema).select("vec_id", *[R(n) for n in names])


@query(f"""{B.sql('locs')}, g AS (SELECT CAST(r.range AS INTEGER) AS "row", CAST(c.range AS INTEGER) AS col FROM range(80) AS r, range(80) AS c),
n AS (SELECT CAST(floor(y + 0.5) AS INTEGER) AS r, CAST(floor(x + 0.5) AS INTEGER) AS c, count(*) AS v FROM locs WHERE x < 63.5 AND y < 63.5 GROUP BY 1, 2),
q AS (SELECT CAST(floor((y + 0.5) / 4) AS INTEGER) AS r, CAST(floor((x + 0.5) / 4) AS INTEGER) AS c, sum(photons) AS v FROM locs WHERE x < 63.5 AND y < 63.5 GROUP BY 1, 2),
p AS (SELECT CAST(floor(y + 0.5) AS INTEGER) AS r, CAST(floor(x + 0.5) AS INTEGER) AS c, max(sigma_nm) AS v FROM locs WHERE x < 20 AND y < 30 GROUP BY 1, 2),
a AS (SELECT "row", col, least(greatest(coalesce(v, 0) / 12.0, 0), 1) AS v FROM g LEFT JOIN n ON r = "row" - 8 AND c = col - 8 WHERE "row" BETWEEN 8 AND 71 AND col BETWEEN 8 AND 71),
b AS (SELECT "row", col, power(least(greatest((coalesce(v, 0) - 20000) / 250000.0, 0), 1), 0.5) AS v FROM g LEFT JOIN q ON r = floor(("row" - 8 - 1.5) / 4 + 0.5) AND c = floor((col - 8 - 1.5) / 4 + 0.5)
  WHERE ("row" - 8 - 1.5) / 4 BETWEEN 0 AND 15 AND (col - 8 - 1.5) / 4 BETWEEN 0 AND 15),
m AS (SELECT "row", col, least(greatest((coalesce(v, 90) - 90) / 200.0, 0), 1) AS v FROM g LEFT JOIN p ON r = "row" - 20 AND c = col - 30 WHERE "row" BETWEEN 20 AND 49 AND col BETWEEN 30 AND 49),
one AS (SELECT "row", col, coalesce(a.v, 0) AS r, coalesce(a.v, 0) * 0.5 AS g, 0.0 AS b FROM a FULL JOIN (SELECT "row", col FROM b UNION SELECT "row", col FROM m) AS u USING ("row", col)),
two AS (SELECT "row", col, CASE WHEN v IS NULL THEN r ELSE r * 0.4 + 0.6 * (CASE WHEN v < 0.5 THEN v * 2 ELSE 1 - (v * 2 - 1) END) END AS r,
  CASE WHEN v IS NULL THEN g ELSE g * 0.4 + 0.6 * (CASE WHEN v < 0.5 THEN 0 ELSE v * 2 - 1 END) END AS g, CASE WHEN v IS NULL THEN b ELSE b * 0.4 + 0.6 * (CASE WHEN v < 0.5 THEN 1 - v * 2 ELSE 0 END) END AS b
  FROM one LEFT JOIN b AS l USING ("row", col))
SELECT "row", col, round(least(CASE WHEN v IS NULL THEN r ELSE least(r, 1 - v) END, 1) + 1.23e-8, 6) AS r, round(least(CASE WHEN v IS NULL THEN g ELSE least(g, 1 - v) END, 1) + 1.23e-8, 6) AS g,
  round(least(CASE WHEN v IS NULL THEN b ELSE least(b, v) END, 1) + 1.23e-8, 6) AS b
FROM two LEFT JOIN m USING ("row", col)""")
def view_of_three_layers(spark, d):
    """Counts added, photons of a coarser grid laid over with a gamma, and the least of both and a smaller image."""
    l = B.locs(spark, d)  # noqa: E741
    field = l.filter("x < 63.5 AND y < 63.5")
    pixel = lambda c, size=1: F.floor((F.col(c) + 0.5) / size).cast("int")
    counts = field.groupBy(pixel("y").alias("row"), pixel("x").alias("col")).agg(F.count(F.lit(1)).alias("value"))
    coarse = field.groupBy(pixel("y", 4).alias("row"), pixel("x", 4).alias("col")).agg(F.sum("photons").alias("value"))
    part = l.filter("x < 20 AND y < 30").groupBy(pixel("y").alias("row"), pixel("x").alias("col")).agg(F.max("sigma_nm").alias("value"))
    layers = [
        compose.Layer(counts, 64, 64, (0.0, 12.0), [(0, 0, 0), (1, 0.5, 0)], offset=(8.5, 8.5), blending="additive"),
        compose.Layer(coarse, 16, 16, (20000.0, 270000.0), [(0, 0, 1), (1, 0, 0), (0, 1, 0)], ((4.0, 0.0), (0.0, 4.0)), (10.0, 10.0), gamma=0.5, opacity=0.6),
        compose.Layer(part, 30, 20, (90.0, 290.0), [(1, 1, 0), (0, 0, 1)], offset=(20.5, 30.5), blending="minimum", background=90.0),
    ]
    view, _ = compose.composite(layers, (0.0, 0.0, 80.0, 80.0), 1.0)
    return view.select("row", "col", *[R(F.col(c) + 1.23e-8, c) for c in "rgb"])


@query(f"""{B.sql('locs')}, s AS (SELECT CAST(floor(y / 2) AS INTEGER) AS r, CAST(floor(x / 2) AS INTEGER) AS c, count(*) AS v FROM locs WHERE x < 64 AND y < 64 GROUP BY 1, 2),
g AS (SELECT CAST(a.range AS INTEGER) AS "row", CAST(b.range AS INTEGER) AS col, round_even((-0.5 + (a.range + 0.5) / 3.0 - 3.3) / 2.0, 0) AS r, round_even((-0.5 + (b.range + 0.5) / 3.0 + 1.2) / 2.0, 0) AS c FROM range(96) AS a, range(120) AS b)
SELECT "row", col, CAST(floor(least(greatest(v * (255.0 / 20), 0), 255)) AS INTEGER) AS r, CAST(floor(least(greatest(v * (255.0 / 20), 0), 255)) AS INTEGER) // 2 AS g, 0 AS b
FROM g JOIN s ON s.r = least(greatest(g.r, 0), 31) AND s.c = least(greatest(g.c, 0), 31)""")
def render_over_camera_image(spark, d):
    """A camera image of 32 x 32 pixels on the grid of a render, in 8-bit colours."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    s = B.locs(spark, d).filter("x < 64 AND y < 64").groupBy(half("y").alias("row"), half("x").alias("col")).agg(F.count(F.lit(1)).alias("value"))
    on = compose.resampled(s, (32, 32), (32, 40), 3, scale=(2.0, 2.0), translate=(3.3, -1.2))
    return compose.colourised(on, 0.0, 20.0, [(1.0, 127.5 / 255, 0.0)])
