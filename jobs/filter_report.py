"""Job 2: filter a table of measured rows by range, and report what the ranges do.

    python -m jobs.filter_report --input FOLDER --output FOLDER [--config FILE]

A preset names measures (expressions over the input) and their bounds; a side that is left open
follows the data, rounded outward.  ``measures`` gets the measures of every row; ``bounds`` the
limits that were used; ``histograms``, partitioned by measure, the counts of all rows and of those
inside all bounds, by the first group column; ``kept``, partitioned by the group columns (here
lang and source), the rows inside.  The shipped preset measures ``documents``: code points, words,
lines, mean word length, share of letters and of digits, as a table of texts is looked at before
it is used.

The input folder holds tables by the config's name pattern, each a file or a folder of part files.
The texts are read twice, once to measure them and once to keep them; bounds and histograms are
made of ``measures``.  The rows that are kept are dealt by their group, large groups to several
tasks.  A rerun overwrites what the first run wrote; partitions of groups that are gone go too.

Null texts count as empty and null groups as ''; measures that are null or NaN (the mean length
of no words) are outside their bounds, and in no histogram.  Repeated rows are rows.  An empty
table gives empty outputs and open bounds.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.operators import filters
from jobs.common import command_line, given, new_folder, read_config, shipped_config

log = logging.getLogger("filter_report")


def measured(rows: DataFrame, config: dict, carry: list[str]) -> DataFrame:
    """The carried columns with the group columns filled and the measures as doubles."""
    groups = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(g) for g in config["groups"]]
    carried = [F.col(c) for c in carry if c not in config["groups"]]
    return rows.select(*groups, *carried, *[F.expr(e).cast("double").alias(f"m_{name}") for name, e in config["measures"].items()])


def used_bounds(rows: DataFrame, config: dict) -> filters.Bounds:
    """The preset's sides where given, else those of the data: a row for each measure."""
    names = [f"m_{m}" for m in config["measures"]]
    data = {r["column"]: (r["low"], r["high"]) for r in filters.default_bounds(rows, names, config["decimals"]).collect()}
    return filters.merged_bounds({f"m_{m}": tuple(b) for m, b in config["bounds"].items()}, data)


def melted(rows: DataFrame, config: dict, kept: Column) -> DataFrame:
    """A row for each measure of a row: measure, its first group, value, bin width, kept."""
    widths = config["bin_widths"]
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"m_{m}").alias("value"), F.lit(float(widths[m])).alias("width")) for m in config["measures"]])
    out = rows.select(F.col(config["groups"][0]).alias("of"), kept.alias("kept"), F.inline(each))
    return out.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def written(table: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Overwrite a table and read it back.  It is read with its schema, as the names of groups may
    look like numbers; the empty name is kept as the null partition."""
    table.write.mode("overwrite").partitionBy(*by).parquet(path)
    out = table.sparkSession.read.schema(table.schema).parquet(path).fillna("", by)
    log.info("wrote %s: %d rows", path, out.count())
    return out.select(table.columns)


def run(spark: SparkSession, source: str, output: str, config: dict) -> dict[str, DataFrame]:
    """Write all tables; they are returned as read back."""
    raw = given(spark, source, config["files"])
    out = {"measures": written(measured(raw, config, config["carry"][:1]), f"{output}/measures", [])}
    bounds = used_bounds(out["measures"], config)
    log.info("read %s, bounds %s", source, bounds)

    rows = melted(out["measures"], config, filters.inside(out["measures"], bounds))
    counts = filters.histograms(rows, F.col("value") / F.col("width"), 1.0, F.col("kept"), ("measure", "of"))
    out["histograms"] = written(counts.repartition("measure"), f"{output}/histograms", ["measure"])
    kept = filters.range_filter(measured(raw, config, config["carry"]), bounds).hint("rebalance", *config["groups"])
    out["kept"] = written(kept, f"{output}/kept", config["groups"])
    limits = [(name.removeprefix("m_"), *(None if side is None else float(side) for side in b)) for name, b in bounds.items()]
    out["bounds"] = written(spark.createDataFrame(limits, "measure string, low double, high double").coalesce(1), f"{output}/bounds", [])
    return out


def whole_output(tables: dict[str, DataFrame], config: dict) -> DataFrame:
    """All output rows in one shape: part, lang, source, item, bin, n_all, n_kept, low, high."""
    none = F.lit(None).cast("double")
    n = F.lit(1).cast("long")
    kept = tables["kept"].select(F.lit("kept").alias("part"), "lang", "source", F.col("doc_id").cast("string").alias("item"), F.col("m_words").cast("long").alias("bin"), n.alias("n_all"), n.alias("n_kept"), none.alias("low"), none.alias("high"))
    bins = tables["histograms"].select(F.lit("histogram").alias("part"), F.col("of").alias("lang"), F.lit("").alias("source"), F.col("measure").alias("item"), "bin", "n_all", "n_kept", none.alias("low"), none.alias("high"))
    zero = F.lit(0).cast("long")
    limits = tables["bounds"].select(F.lit("bounds").alias("part"), F.lit("").alias("lang"), F.lit("").alias("source"), F.col("measure").alias("item"), zero.alias("bin"), zero.alias("n_all"), zero.alias("n_kept"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))
    return kept.unionByName(bins).unionByName(limits)


def job2_filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the given ``documents`` into one new folder."""
    config, output = shipped_config(__file__), new_folder(spark, "job2")
    run(spark, sf_dir, output, config)
    return whole_output(run(spark, sf_dir, output, config), config)


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
c AS (
  SELECT doc_id, lang, source, length(text)::DOUBLE AS chars,
         (length(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g')) - length(regexp_replace(text, '[^\x20\x09-\x0D]+', '', 'g')))::DOUBLE AS words,
         (1 + length(text) - length(replace(text, chr(10), '')))::DOUBLE AS lines,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::DOUBLE AS ink,
         length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE AS digits,
         length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g'))::DOUBLE AS letters
  FROM t),
m AS (
  SELECT doc_id, lang, source, chars, words, lines, CASE WHEN words > 0 THEN ink / words END AS word_length,
         CASE WHEN ink > 0 THEN letters / ink END AS letter_share, CASE WHEN ink > 0 THEN digits / ink END AS digit_share
  FROM c),
long AS (
  UNPIVOT (SELECT *, (words BETWEEN 5 AND (SELECT ceil(max(words) * 1000) / 1000 FROM m) AND chars BETWEEN (SELECT floor(min(chars) * 1000) / 1000 FROM m) AND 20000
                      AND lines BETWEEN (SELECT floor(min(lines) * 1000) / 1000 FROM m) AND (SELECT ceil(max(lines) * 1000) / 1000 FROM m) AND word_length BETWEEN 2 AND 12
                      AND letter_share BETWEEN 0.6 AND (SELECT ceil(max(letter_share) * 1000) / 1000 FROM m) AND digit_share BETWEEN (SELECT floor(min(digit_share) * 1000) / 1000 FROM m) AND 0.2) IS TRUE AS kept FROM m)
  ON chars, words, lines, word_length, letter_share, digit_share INTO NAME measure VALUE v),
widths(measure, w) AS (VALUES ('chars', 500.0), ('words', 100.0), ('lines', 5.0), ('word_length', 0.5), ('letter_share', 0.05), ('digit_share', 0.02)),
fixed(measure, low, high) AS (VALUES ('chars', NULL, 20000.0), ('words', 5.0, NULL), ('lines', NULL, NULL), ('word_length', 2.0, 12.0), ('letter_share', 0.6, NULL), ('digit_share', NULL, 0.2))
SELECT 'kept' AS part, lang, source, CAST(doc_id AS VARCHAR) AS item, CAST(v AS BIGINT) AS bin, 1::BIGINT AS n_all, 1::BIGINT AS n_kept, NULL::DOUBLE AS low, NULL::DOUBLE AS high
FROM long WHERE measure = 'words' AND kept
UNION ALL
SELECT 'histogram', lang, '', measure, CAST(floor(v / w::DOUBLE) AS BIGINT), count(*), count(*) FILTER (kept), NULL, NULL
FROM long JOIN widths USING (measure) GROUP BY ALL
UNION ALL
SELECT 'bounds', '', '', measure, 0, 0, 0, round(coalesce(any_value(low)::DOUBLE, floor(min(v) * 1000) / 1000), 3), round(coalesce(any_value(high)::DOUBLE, ceil(max(v) * 1000) / 1000), 3)
FROM long JOIN fixed USING (measure) GROUP BY measure
"""


def main() -> None:
    args = command_line(__doc__.splitlines()[0])
    spark = SparkSession.builder.appName("filter_report").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.input, args.output, read_config(spark, args.config, __file__))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
