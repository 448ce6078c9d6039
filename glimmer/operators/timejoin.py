"""As-of joins on a time axis: nearest, interpolated, clamped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(left: DataFrame, right: DataFrame, left_t: str, right_t: str, columns: list[str], width: float) -> DataFrame:
    """Each left row with structs ``before`` (last right row at or before its time) and
    ``after`` (first right row after it), of the right time ``t`` and ``columns``.

    Time is cut into buckets of ``width``.  A bucket sees its own right rows and one carried
    in from either side, so no task handles the whole axis; only one row per bucket is
    ordered globally.  Right rows of one time: the first by its columns counts.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    item = F.struct(F.col(right_t).cast("double").alias("t"), *[F.col(c) for c in columns])
    points = right.filter(F.col(right_t).isNotNull()).select(bucket(right_t).alias("b"), item.alias("p"))
    l = left.withColumn("_b", bucket(left_t)).withColumn("_t", F.col(left_t).cast("double"))  # noqa: E741
    ends = points.groupBy("b").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    all_b = l.select(F.col("_b").alias("b")).distinct().join(ends, "b", "full")
    axis = Window.orderBy("b")  # a row per bucket
    carried = all_b.select(
        "b",
        F.last("high", True).over(axis.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("low", True).over(axis.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    extra = points.select("b", "p").unionByName(carried.select("b", F.col("before").alias("p"))).unionByName(carried.select("b", F.col("after").alias("p"))).filter("p IS NOT NULL")
    empty = F.lit(None).cast(points.schema["p"].dataType)
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    rows = l.select(F.col("_b").alias("b"), F.col("_t").alias("t"), row.alias("row"), F.lit(1).alias("own"), empty.alias("p")).unionByName(
        extra.select("b", F.col("p.t").alias("t"), F.lit(None).cast(l.select(row.alias("r")).schema["r"].dataType).alias("row"), F.lit(0).alias("own"), "p")
    )
    order = Window.partitionBy("b").orderBy("t", "own", F.col("p").desc_nulls_last())
    met = rows.withColumn("before", F.last("p", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "after", F.first("p", True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    return met.filter("own = 1").select("row.*", "before", "after")


def nearest(left: DataFrame, right: DataFrame, left_t: str, right_t: str, columns: list[str], width: float) -> DataFrame:
    """The right row nearest in time; of two equally near the earlier."""
    met = neighbours(left, right, left_t, right_t, columns, width)
    t = F.col(left_t).cast("double")
    first = F.col("after").isNull() | (F.col("before").isNotNull() & (t - F.col("before.t") <= F.col("after.t") - t))
    pick = F.when(first, F.col("before")).otherwise(F.col("after"))
    return met.withColumn("_p", pick).select(*left.columns, F.col("_p.t").alias(f"{right_t}_found"), *[F.col(f"_p.{c}").alias(c) for c in columns])


def interpolated(left: DataFrame, right: DataFrame, left_t: str, right_t: str, columns: list[str], width: float) -> DataFrame:
    """Linear interpolation of right columns at the left times; the edge value is held outside."""
    met = neighbours(left, right, left_t, right_t, columns, width)
    t = F.col(left_t).cast("double")

    def at(c: str) -> Column:
        a, b = F.col(f"before.{c}"), F.col(f"after.{c}")
        w = (t - F.col("before.t")) / F.nullif(F.col("after.t") - F.col("before.t"), F.lit(0.0))
        return F.when(F.col("before").isNull(), b).when(F.col("after").isNull(), a).otherwise(a + (b - a) * w).alias(c)

    return met.select(*left.columns, *[at(c) for c in columns])


def clamped_lookup(left: DataFrame, series: DataFrame, frame: str, columns: list[str], n: int) -> DataFrame:
    """Per-frame values with the frame clipped to 0 .. n - 1; ``outside`` tells clipped rows.

    The series has one row per frame of a movie; it is small by nature and Spark decides
    from its size whether to broadcast it."""
    key = F.least(F.greatest(F.col(frame), F.lit(0)), F.lit(n - 1))
    rows = left.withColumn("_k", key).withColumn("outside", F.col(frame) != key)
    return rows.join(series.select(F.col(frame).alias("_k"), *columns), "_k", "left").drop("_k")
