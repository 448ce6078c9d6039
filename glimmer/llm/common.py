"""Shared-folder tables and small helpers of the text operators."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm import textkit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set, and
    only where both are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="glimmer-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost
    executor costs only the tasks that were running on it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that were stored inside ``finished`` calls, innermost last.
_scratch: list[list[str]] = []


def finished(name: str):
    """Store what a function returns under a name, then delete the tables it stored before."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(df: DataFrame, *args, **kwargs) -> DataFrame:
            _scratch.append([])
            made = []
            try:
                out = fn(df, *args, **kwargs)
                made, kept = list(_scratch[-1]), stored(out, name)
                _scratch[-1] = [p for p in _scratch[-1] if p not in made]
            finally:
                left = _scratch.pop()
                if _scratch:  # the result is a table of the function around
                    _scratch[-1] += left
                jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
                for p in made:
                    path = jvm.org.apache.hadoop.fs.Path(p)
                    path.getFileSystem(conf).delete(path, True)
            return kept

        return run

    return wrap


def as_text(column: str | Column) -> Column:
    """Null text counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def arrow_chunks(
    batches: Iterator[pa.RecordBatch], text: str, values: np.ndarray, hashes: int = 1
) -> Iterator[tuple[pa.RecordBatch, textkit.Words]]:
    """Each run of rows of a mapInArrow input with its words."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for i, w in textkit.chunks(column, values, hashes):
            yield batch.slice(i, len(w.first) - 1), w


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def i64(h: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's signed longs."""
    return np.ascontiguousarray(h).view(np.int64)


#: A group with more than this share of all rows is hot; there can be no more than its inverse of them.
HOT_SHARE = 0.001
#: Rows of a few dozen bytes that may be broadcast after they were counted.
BROADCAST_ROWS = 500_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Join rows with the one row of their group without sending a hot group to one task.

    Groups of more than ``HOT_SHARE`` of all rows number fewer than its inverse, so they are
    broadcast; the others are small enough to be shuffled.
    """
    most = max(1, int(total * HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col(size) > most))
    warm = rows.join(hot, keys)
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(groups.filter(F.col(size) <= most), keys)
    return warm.unionByName(cold)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table that was counted, if it is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
