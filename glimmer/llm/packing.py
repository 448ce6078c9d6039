"""Optimal length buckets and token-budget batches.

Token counts of all documents form one histogram (lengths beyond ``EXACT_LENGTHS``
are counted in bins 1/64 wide, each with its longest length, so it has a few
thousand entries at any size).  Dynamic programming over it chooses at most
``buckets`` boundaries with the least padding.  Inside a bucket every row is padded
to the boundary, so a batch of a token budget is a fixed number of rows.  A bucket
is dealt by a hash of the id into shares of about ``SHARE_ROWS`` rows; batches are
cut inside a share, so no task ever sees a whole bucket and each share has one
batch that is not full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.common import as_text, stored

EXACT_LENGTHS = 2048
SHARE_ROWS = 20_000
#: A token, as it is counted here: a run of letters and digits, or one other visible character.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def token_count(text: str | Column) -> Column:
    return F.regexp_count(as_text(text), F.lit(TOKEN)).cast("long")


def length_bin(n: Column) -> Column:
    """The bin of a length: itself up to ``EXACT_LENGTHS``, then 64 to a power of two."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)))) - 6)
    return F.when(n <= EXACT_LENGTHS, n).otherwise((F.ceil(n / step) * step).cast("long"))


def boundaries(longest: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """Bucket boundaries (each the longest length in its bucket) with the least padding.

    ``longest``, ``counts`` and ``totals`` describe the histogram in order of length:
    the longest length, the rows and the tokens of each bin.
    """
    n = len(longest)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    tokens = np.concatenate([[0], np.cumsum(totals, dtype=np.float64)])
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        for j in range(1, n + 1):  # the last bucket holds bins i .. j-1
            cost = best[:j] + longest[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            new[j], cut[j] = cost[i], i
        back.append(cut)
        best = new
    out, j = [], n
    for cut in reversed(back):
        if j:
            out.append(int(longest[j - 1]))
            j = int(cut[j])
    return sorted(set(out))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, budget: int = 65_536, tokens: Column | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, bucket_len, batch, slot, batch_rows.

    ``batch`` names bucket, share and number; ``slot`` is the place in the batch and
    ``batch_rows`` the rows that fit into the budget (one, for a row longer than the
    budget, which is kept whole).  Null and empty texts have no tokens and are packed
    like others; ties are ordered by id, nulls first; repeated rows are packed each; an
    empty table gives no rows; other columns are ignored.  ``tokens`` replaces the count
    of tokens, for instance by that of a tokenizer.
    """
    n = token_count(text_col) if tokens is None else tokens
    sized = stored(docs.select(F.col(id_col).alias("id"), n.alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "pack-lengths")
    sized = sized.withColumn("bin", length_bin(F.col("n_tokens")))
    histogram = sized.groupBy("bin").agg(F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens")).orderBy("bin").collect()
    longest, rows, total = (np.array([r[k] for r in histogram], np.int64) for k in (1, 2, 3))
    ends = boundaries(longest, rows, total, buckets)
    if not ends:
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, n_tokens long, bucket_len long, batch string, slot int, batch_rows long")
    bucket, shares = F.lit(ends[-1]), F.lit(1)
    for low, end in reversed(list(zip([-1, *ends[:-1]], ends, strict=True))):
        here = rows[(longest > low) & (longest <= end)].sum()
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end)).otherwise(bucket)
        shares = F.when(F.col("n_tokens") <= end, F.lit(int(-(-here // SHARE_ROWS)))).otherwise(shares)
    dealt = sized.withColumn("bucket_len", bucket.cast("long")).withColumn("share", F.pmod(F.xxhash64("row"), shares.cast("long")))
    dealt = dealt.withColumn("batch_rows", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long"))
    place = F.row_number().over(Window.partitionBy("bucket_len", "share").orderBy("id", "row")) - 1
    placed = dealt.withColumn("place", place)
    number = F.floor(F.col("place") / F.col("batch_rows"))
    return placed.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "bucket_len",
        F.concat_ws("-", "bucket_len", "share", number).alias("batch"),
        (F.col("place") % F.col("batch_rows")).cast("int").alias("slot"),
        "batch_rows",
    )
