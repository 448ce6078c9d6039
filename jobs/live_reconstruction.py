"""Job 1, incremental: the reconstruction of an acquisition that is still growing.

    python -m jobs.live_reconstruction --input FOLDER --output FOLDER [--config FILE]

New localization files of the input folder are taken by a file stream (availableNow, with a
checkpoint), mapped to localization columns, filtered by range, put into movie blocks of so many
camera frames, and appended to ``localizations``, partitioned by block.  Then the blocks that
hold more or fewer rows than was last recorded are counted into pixels again and overwrite their
partitions of ``image``; the record of them in ``blocks`` is written last.  A run that is stopped
anywhere is made good by the next one: the stream goes on from its checkpoint, and a block
without its record is done again.  A run without new files changes nothing.

Output, under the output folder: ``localizations`` (movie_frame, frame, x, y, photons,
uncertainty_nm), ``image`` (movie_frame, row, col, n, photons, best_nm), ``blocks`` (movie_frame,
n), ``checkpoint``.

Rows with a null or NaN in a filtered column are left out by the range filter, rows without a
position or frame as well; repeated rows are rows.  Other input columns are not read.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.operators import render
from glimmer.operators.filters import range_filter
from glimmer.session import cut
from jobs.common import command_line, new_folder, read_config, shipped_config, table_or_none

log = logging.getLogger("live_reconstruction")

BLOCKS = "movie_frame int, n long"
IMAGE = "movie_frame int, row int, col int, n long, photons double, best_nm double"


def localizations(raw: DataFrame, config: dict) -> DataFrame:
    """The kept localizations of raw rows, with the movie block of each."""
    mapped = raw.select(*[F.expr(e).alias(name) for name, e in config["columns"].items()])
    bounds = {name: tuple(b) for name, b in config["bounds"].items()}
    kept = range_filter(mapped, bounds).filter("frame IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    block = render.tumbling(F.col("frame"), 0, config["frames_per_block"])
    return kept.select(block.alias("movie_frame"), *config["columns"])


def present(spark: SparkSession, source: str, config: dict) -> DataFrame:
    return spark.read.option("pathGlobFilter", config["files"]).parquet(source)


def take_new(spark: SparkSession, source: str, output: str, config: dict) -> int:
    """Append the localizations of files that the checkpoint has not seen; rows that were read."""
    raw = (
        spark.readStream.schema(present(spark, source, config).schema).option("pathGlobFilter", config["files"])
        .option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    )
    query = (
        localizations(raw, config).writeStream.format("parquet").outputMode("append").partitionBy("movie_frame")
        .option("path", f"{output}/localizations").option("checkpointLocation", f"{output}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    read = 0
    for progress in query.recentProgress:
        read += progress["numInputRows"]
        log.info("batch %s: %s rows read from %s", progress["batchId"], progress["numInputRows"], source)
    return read


def changed_blocks(spark: SparkSession, held: DataFrame, output: str) -> DataFrame:
    """Blocks whose number of localizations is not the recorded one."""
    now = held.groupBy("movie_frame").agg(F.count(F.lit(1)).alias("n"))
    done = table_or_none(spark, f"{output}/blocks", BLOCKS)
    return cut(now if done is None else now.join(done, ["movie_frame", "n"], "left_anti"))


def draw(spark: SparkSession, source: str, output: str, config: dict) -> int:
    """Count the changed blocks into pixels, then record them; the number of them."""
    held = table_or_none(spark, f"{output}/localizations", localizations(present(spark, source, config), config).schema)
    if held is None:
        return 0
    changed = changed_blocks(spark, held, output)
    n = changed.count()
    log.info("%d blocks to draw", n)
    if not n:
        return 0
    rows = held.join(changed.select("movie_frame"), "movie_frame", "left_semi")
    pixels = render.binned(rows, config["width"], config["height"], config["oversampling"]).groupBy("movie_frame", "row", "col")
    image = pixels.agg(F.count(F.lit(1)).alias("n"), F.sum("photons").alias("photons"), F.min("uncertainty_nm").alias("best_nm"))
    for name, table in (("image", image.repartition("movie_frame")), ("blocks", changed.repartition("movie_frame"))):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("movie_frame").parquet(f"{output}/{name}")
        log.info("wrote %d partitions of %s/%s", n, output, name)
    return n


def run(spark: SparkSession, source: str, output: str, config: dict) -> DataFrame:
    """Take what is new, draw what it changed, and return the image."""
    read = take_new(spark, source, output, config)
    drawn = draw(spark, source, output, config)
    log.info("read %d new rows, drew %d blocks", read, drawn)
    image = table_or_none(spark, f"{output}/image", IMAGE)
    return spark.createDataFrame([], IMAGE) if image is None else image


def job1_live_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the given ``lineitem`` into one new folder."""
    config, output = shipped_config(__file__), new_folder(spark, "job1")
    run(spark, sf_dir, output, config)
    return run(spark, sf_dir, output, config)


SQL = """
WITH l AS (
  SELECT (l_orderkey * 13 + l_partkey * 7 + l_linenumber) % 1000 AS frame,
         ((l_partkey * 7919 + l_orderkey * 31) % 64000) / 1000.0 AS x,
         ((l_suppkey * 104729 + l_orderkey * 17 + l_linenumber * 977) % 64000) / 1000.0 AS y,
         100.0 + l_partkey % 150 AS sigma_nm, l_quantity * 40.0 + 200 AS photons, 8.0 + (l_suppkey * 7 + l_orderkey) % 32 AS uncertainty_nm
  FROM lineitem)
SELECT CAST(frame // 100 AS INTEGER) AS movie_frame, CAST(floor((y + 0.5) * 2) AS INTEGER) AS "row", CAST(floor((x + 0.5) * 2) AS INTEGER) AS col,
       count(*) AS n, CAST(sum(photons) AS DOUBLE) AS photons, CAST(min(uncertainty_nm) AS DOUBLE) AS best_nm
FROM l WHERE sigma_nm BETWEEN 110 AND 240 AND photons >= 300 AND uncertainty_nm <= 36 AND x < 63.5 AND y < 63.5
GROUP BY ALL
"""


def main() -> None:
    args = command_line(__doc__.splitlines()[0])
    spark = SparkSession.builder.appName("live_reconstruction").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.input, args.output, read_config(spark, args.config, __file__))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
