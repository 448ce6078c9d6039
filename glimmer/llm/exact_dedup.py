"""Exact duplicates by 128-bit content hash, checked byte for byte.

Texts are grouped by the MD5 of the normalised text (all characters of
``[\\x20\\x09-\\x0D]`` deleted).  Only fixed-size rows - id, length, digests -
are shuffled for grouping; the byte comparison inside the groups is a
``min``/``max`` over the normalised bytes, which Spark combines on the map side,
so a group that holds a third of all rows sends one row per task.  Where the two
differ, the group is split by its bytes.  Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import as_text, join_groups, small, stored

SPACES = " \t\n\x0b\f\r"


def normalised(text: str | Column) -> Column:
    return F.translate(as_text(text), SPACES, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The row of a group with the most code points in its original text stays, then
    the one with the smallest id.  Null text is empty (all empty texts are one
    group), a null id sorts after every other id, repeated rows with one id are
    members of their group and exactly one of them is kept, an empty table gives
    an empty result, and other columns of the input are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.char_length(as_text(text_col)).cast("long").alias("points"), normalised(text_col).alias("body")
    )
    digests = stored(
        rows.select("id", "points", F.unhex(F.md5("body")).alias("h"), F.sha2("body", 256).alias("sha"), F.monotonically_increasing_id().alias("row")),
        "exact-digests",
    )
    # Members that may be equal; their bytes are compared per group, combined map-side.
    several = stored(digests.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "exact-several")
    bodies = rows.select(F.unhex(F.md5("body")).alias("h"), F.col("body").cast("binary").alias("body"))
    bodies = bodies.join(small(several, several.count()), "h", "left_semi")
    spans = bodies.groupBy("h").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    unequal = stored(spans.filter("low <> high").select("h"), "exact-collisions")
    if unequal.isEmpty():
        keyed = digests.withColumn("part", F.lit(""))
    else:
        # Two texts with one MD5: their SHA-256 tells them apart, as the bytes of a collision differ.
        keyed = digests.join(unequal.withColumn("hit", F.lit(True)), "h", "left").withColumn(
            "part", F.when(F.col("hit"), F.col("sha")).otherwise("")
        ).drop("hit")
    best = F.min(F.struct((-F.col("points")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("id"), F.col("row").alias("row")))
    groups = stored(keyed.groupBy("h", "part").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    return join_groups(keyed, groups, ["h", "part"], "group_size", digests.count()).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
