"""Domain tables made from the driver's tables by integer arithmetic, so that any SQL engine
gets the same numbers.  Each has a DataFrame form and the text of a SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIXEL_NM = 100.0

SQL = {
    "tracks": """tracks AS (
  SELECT user_id AS particle, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS frame,
         ((event_id * 7919) % 64000) / 1000.0 AS x, ((event_id * 104729) % 64000) / 1000.0 AS y,
         (15000 + (event_id * 31) % 20000) / 1000.0 AS sigma, value AS photons
  FROM events)""",
    "walks": """walks AS (
  SELECT user_id AS particle,
         CAST(row_number() OVER w - 1 + sum(CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS frame,
         CAST(sum((event_id * 7919) % 201 - 100) OVER w AS BIGINT) / 1000.0 AS x,
         CAST(sum((event_id * 104729) % 201 - 100) OVER w AS BIGINT) / 1000.0 AS y,
         (15000 + (event_id * 31) % 20000) / 1000.0 AS sigma
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING))""",
    "locs": """locs AS (
  SELECT (l_orderkey * 13 + l_partkey * 7 + l_linenumber) % 1000 AS frame,
         ((l_partkey * 7919 + l_orderkey * 31) % 64000) / 1000.0 AS x,
         ((l_suppkey * 104729 + l_orderkey * 17 + l_linenumber * 977) % 64000) / 1000.0 AS y,
         (100 + l_partkey % 150) * 1.0 AS sigma_nm, l_quantity * 40 + 200 AS photons,
         8.0 + (l_suppkey * 7 + l_orderkey) % 32 AS uncertainty_nm, l_extendedprice AS net_gradient
  FROM lineitem)""",
    "record": """record AS (
  SELECT (o_custkey * 37 + o_orderkey) % 4000 * 2.5 AS t,
         CAST(sum(o_custkey % 1001) AS BIGINT) * 0.01 / count(*) - 5 AS dx,
         CAST(sum(o_orderkey % 1001) AS BIGINT) * 0.01 / count(*) - 5 AS dy
  FROM orders WHERE (o_custkey * 37 + o_orderkey) % 4000 * 2.5 < 9000 GROUP BY 1)""",
    "pages": """pages_t AS (
  SELECT DISTINCT event_id % 5000 AS page, (event_id % 5000) * 0.0313 + ((event_id % 5000) * 7919 % 11) * 0.0001 + 12.0 AS t,
         (event_id % 5000) % 7 // 4 AS backlog
  FROM events WHERE (event_id % 5000) % 13 <> 0)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Window]:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return e, Window.partitionBy("user_id").orderBy("ts")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, w = _points(spark, sf_dir)
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("particle"), (F.row_number().over(w) - 1).cast("long").alias("frame"),
        ((i * 7919) % 64000 / 1000.0).alias("x"), ((i * 104729) % 64000 / 1000.0).alias("y"),
        ((15000 + (i * 31) % 20000) / 1000.0).alias("sigma"), F.col("value").alias("photons"),
    )


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, w = _points(spark, sf_dir)
    i, run = F.col("event_id"), w.rowsBetween(Window.unboundedPreceding, 0)
    skip = F.sum(F.when(i % 17 == 0, 1).otherwise(0)).over(run)
    return e.select(
        F.col("user_id").alias("particle"), (F.row_number().over(w) - 1 + skip).cast("long").alias("frame"),
        (F.sum((i * 7919) % 201 - 100).over(run) / 1000.0).alias("x"), (F.sum((i * 104729) % 201 - 100).over(run) / 1000.0).alias("y"),
        ((15000 + (i * 31) % 20000) / 1000.0).alias("sigma"),
    )


def locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p, s, n = (F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey", "linenumber"))
    return table(spark, sf_dir, "lineitem").select(
        ((o * 13 + p * 7 + n) % 1000).alias("frame"), ((p * 7919 + o * 31) % 64000 / 1000.0).alias("x"),
        ((s * 104729 + o * 17 + n * 977) % 64000 / 1000.0).alias("y"), ((100 + p % 150) * 1.0).alias("sigma_nm"),
        (F.col("l_quantity") * 40 + 200).alias("photons"), (8.0 + (s * 7 + o) % 32).alias("uncertainty_nm"), F.col("l_extendedprice").alias("net_gradient"),
    )


def record(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("t", (F.col("o_custkey") * 37 + F.col("o_orderkey")) % 4000 * 2.5)
    mean = lambda c: F.sum(F.col(c) % 1001) * 0.01 / F.count(F.lit(1)) - 5
    return o.filter("t < 9000").groupBy("t").agg(mean("o_custkey").alias("dx"), mean("o_orderkey").alias("dy"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5000
    e = table(spark, sf_dir, "events").filter(k % 13 != 0)
    return e.select(k.alias("page"), (k * 0.0313 + (k * 7919 % 11) * 0.0001 + 12.0).alias("t"), F.floor(k % 7 / 4).alias("backlog")).distinct()


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
