"""A training-corpus pipeline over ``documents``.

quality classifier, line dedup, near-dedup, benchmark decontamination, packing.  Each
stage takes (spark, docs, sf_dir), works on all that the one before kept and returns the
columns of ``documents``; the last returns the packed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm import decontaminate as leaks
from glimmer.llm import line_dedup, near_dedup, packing, quality
from glimmer.llm.common import small, stored, table


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not listed; a null id is a value like others."""
    listed = stored(ids.select("doc_id").distinct(), "pipeline-ids").alias("listed")
    same = F.col("docs.doc_id").eqNullSafe(F.col("listed.doc_id"))
    return docs.alias("docs").join(small(listed, listed.count()), same, "left_anti")


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier, or nearly so, are cut out; n_chars follows the text."""
    cut = line_dedup.without_lines(docs, line_dedup.line_dedup(docs))
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    found = near_dedup.near_dedup(docs)
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept")
    return _without(docs, gone)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return _without(docs, leaks.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", reject_bad),
    ("line_dedup", drop_lines),
    ("near_dedup", one_of_each),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]

#: SQL cannot express the trained classifier or the sampled signatures; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
