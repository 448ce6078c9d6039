"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of the five-word shingles of all documents go into ``SKETCHES``
   tables of ``CELLS`` counters; the median load of a table is what a counter holds of rare
   shingles, and the median of the tables leaves out chance meetings with frequent ones
   (a sketch of fixed size).  The weight of a shingle is its count in the document times an
   inverse frequency smoothed to the range 1 to 2.
2. Each text is sampled ``BANDS * ROWS`` times; two texts draw the same sample with
   the probability of their weighted Jaccard similarity.  ``ROWS`` samples are a band.
   Texts with one word sequence (by a 128-bit BLAKE2b of it) are sampled and compared once.
3. Texts that share a band meet in a bucket.  The text of a bucket that meets the most others
   is its hub; the buckets of one hub are one group.  Every text of a group is compared with
   its hub, word for word.
4. That leaves the pairs of a group of which at least one text is not linked to the hub
   (an *open* text).  As weighted sets, let D(x) be the weight of the difference of x and the
   hub, w(x) that of x, k = (1 - s) / (1 + s) for the threshold s, and f(x) = D(x) - k w(x).
   A similarity of s or more between x and y means that the weight they have in common *of
   their differences* is at least (f(x) + f(y)) / 2.  The hub has the least f there is, so
   where that bound is not positive both texts are linked to the hub; everywhere else x and y
   share a shingle of their differences, and, with these ordered from rare to common in the
   group, one from which on both still have that much weight.  A join on it finds all such
   pairs (few, as differences rarely agree), which are compared word for word too.
   So no pair of a bucket is left out, and no bucket is compared pairwise.
5. A comparison is exact: weighted Jaccard over all shingles of both whole texts.
6. Classes are the connected components of the links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm import textkit
from glimmer.llm.common import arrow_chunks, finished, i64, join_groups, small, stored
from glimmer.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 no band is shared with a probability of 0.0002.
BANDS, ROWS = 12, 3
#: Counters of a table of the frequency sketch, and tables.
CELLS, SKETCHES = 1 << 18, 3
_PART = 1 << 14
#: Comparisons with one hub in one task, about.
HUB_SHARE = 256
#: The share of the two weights that the difference of linked texts may have.
_APART = (1 - SIMILARITY) / (1 + SIMILARITY)
#: Slack of the bounds, so that rounding never leaves a pair out.
_SLACK = 1e-3

U64 = np.uint64
_LEVELS = 4096


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd multipliers, one a sample, and quantiles of Gamma(2, 1) and of its logarithm."""
    seeds = textkit.mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    q = (np.arange(_LEVELS) + 0.5) / _LEVELS
    low, high = np.zeros(_LEVELS), np.full(_LEVELS, 40.0)
    for _ in range(60):  # the distribution function is 1 - (1 + x) exp(-x)
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    gamma = (low + high) / 2
    return seeds, gamma.astype(np.float32), np.log(gamma).astype(np.float32)


_SEEDS, _GAMMA, _LOG_GAMMA = _constants()


def shingles(w: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the text each belongs to; a text of fewer than five words is one."""
    h, ok = w.windows(SHINGLE)
    own = w.owner
    h, at = h[ok], own[: len(ok)][ok]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        h = np.concatenate([h, w.ranges(w.first[short], w.first[short + 1])])
        at = np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


def per_text(w: textkit.Words):
    """Distinct shingles of each text with their counts."""
    h, at = shingles(w)
    bounds = np.searchsorted(at, np.arange(len(w.first)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(h[a:b], return_counts=True)


class Weights:
    """Inverse document frequencies, smoothed, of every counter of every table."""

    def __init__(self, totals: np.ndarray, texts: int) -> None:
        df = np.clip(totals - np.median(totals, axis=1, keepdims=True), 1, max(texts, 1))
        self.tables = (1 + np.log((texts + 1) / (df + 1)) / np.log(texts + 2)).astype(np.float32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        a, b, c = (t[_cell(h, k)] for k, t in enumerate(self.tables))
        return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def _cell(h: np.ndarray, table: int) -> np.ndarray:
    return ((h >> U64(18 * table)) & U64(CELLS - 1)).astype(np.int64)


def idf(docs: DataFrame, text_col: str) -> Weights:
    """Weights from all documents."""

    def count(batches):
        total, texts = np.zeros((SKETCHES, CELLS), np.int64), 0
        for _, w in arrow_chunks(batches, text_col, textkit.FOLDED):
            h, at = shingles(w)
            _, i = np.unique(h ^ textkit.mix(at.astype(U64) + U64(1)), return_index=True)
            for k in range(SKETCHES):
                total[k] += np.bincount(_cell(h[i], k), minlength=CELLS)
            texts += len(w.first) - 1
        flat = total.reshape(-1).astype(np.int32)
        part = [flat[i : i + _PART].tobytes() for i in range(0, len(flat), _PART)]
        n = [texts] + [0] * (len(part) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part), dtype=np.int32)), pa.array(part, pa.binary()), pa.array(n)], ["part", "counts", "texts"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        texts = 0
        for rows in batches:
            for k, c, n in zip(*(x.to_pylist() for x in rows.columns), strict=True):
                one = np.frombuffer(c, np.int32)
                if k in totals:
                    totals[k] += one
                else:
                    totals[k] = one.astype(np.int64)
                texts += n
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary()), pa.array([texts] + [0] * (len(totals) - 1))], ["part", "counts", "texts"])

    schema = "part int, counts binary, texts long"
    parts = docs.select(text_col).mapInArrow(count, schema).repartition(SKETCHES * CELLS // _PART, "part").mapInArrow(add, schema).collect()
    total, n = np.zeros(SKETCHES * CELLS), 0
    for k, c, texts in parts:
        total[k * _PART : (k + 1) * _PART] += np.frombuffer(bytes(c), np.int64)
        n += texts
    return Weights(total.reshape(SKETCHES, CELLS), n)


def sample(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The band hashes of a weighted set."""
    x = h[None, :] * _SEEDS[:, None]
    r = _GAMMA[(x >> U64(52)).astype(np.int32)]
    beta = ((x >> U64(16)) & U64(0xFFFFFF)).astype(np.float32) * np.float32(1 / (1 << 24))
    t = np.floor(np.log(weight).astype(np.float32)[None, :] / r + beta)
    a = _LOG_GAMMA[((x >> U64(40)) & U64(_LEVELS - 1)).astype(np.int32)] - r * (t - beta + 1)
    k = a.argmin(1)
    drawn = textkit.mix(h[k] ^ textkit.mix(t[np.arange(len(k)), k].astype(np.int64).view(U64) + U64(7)))
    drawn = drawn.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=U64)
    for j in range(ROWS):
        out = textkit.mix(out ^ drawn[:, j])
    return out


_SPELL = bytes(b + 32 if 65 <= b <= 90 else b if textkit.FOLDED[b] else 32 for b in range(256))


def identities(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """128 bits of a digest of each text's word sequence, as two longs."""
    found = [hashlib.blake2b(b" ".join((t or "").encode().translate(_SPELL).split()), digest_size=16).digest() for t in texts.to_pylist()]
    both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _signatures(docs: DataFrame, weights) -> DataFrame:
    """(id, key, c1, c2, bands): the word sequence's identity and the bands of each row."""

    def run(batches):
        for rows, w in arrow_chunks(batches, "body", textkit.FOLDED):
            bands = [i64(sample(h, n * weights.value(h))) if len(h) else np.zeros(0, np.int64) for h, n in per_text(w)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *identities(rows.column(2)), pa.array(bands, pa.list_(pa.int64()))], ["id", "key", "c1", "c2", "bands"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, key long, c1 long, c2 long, bands array<long>")


def _bodies(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, body) of the given texts, found by the id of a row that has them."""

    def check(batches):
        for rows in batches:
            c1, c2 = identities(rows.column(1))
            same = (c1.to_numpy() == rows.column(2).to_numpy()) & (c2.to_numpy() == rows.column(3).to_numpy())
            yield rows.select(["u", "body"]).filter(pa.array(same))

    met = docs.select("key", "body").join(texts.select("key", "u", "c1", "c2"), "key").select("u", "body", "c1", "c2")
    # Rows with one id and one text are one text.
    return met.mapInArrow(check, "u long, body string").dropDuplicates(["u"])


def _difference(one: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The n-th occurrences of shingles that only one of two texts has, and their weights."""
    (h, n, w), (h2, n2, w2) = one, other
    _, i, j = np.intersect1d(h, h2, assume_unique=True, return_indices=True)
    a, b = np.zeros(len(n), np.int64), np.zeros(len(n2), np.int64)  # occurrences that the other has
    a[i], b[j] = np.minimum(n[i], n2[j]), np.minimum(n[i], n2[j])
    more = np.concatenate([n - a, n2 - b])
    at = np.repeat(np.arange(len(more)), more)
    number = np.concatenate([a, b])[at] + np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)
    return textkit.mix(np.concatenate([h, h2])[at] ^ textkit.mix(number.astype(U64) + U64(1))), np.concatenate([w, w2])[at]


_MET = "a long, b long, linked boolean, n long, f double, fh double, tokens array<long>, weights array<float>"


def _compare(pairs: DataFrame, bodies: DataFrame, weights) -> DataFrame:
    """Pairs (a, b, n, share) with whether they are linked, f of b and of a, and, where more
    than two texts met (n), the difference of b from a."""

    def run(batches):
        hub, of = None, None
        for rows, w in arrow_chunks(batches, "body", textkit.FOLDED):
            out = []
            for a, b, n, (h, c) in zip(*(rows.column(k).to_pylist() for k in range(3)), per_text(w), strict=True):
                mine = (h, c, weights.value(h))
                total = float((mine[1] * mine[2].astype(np.float64)).sum())
                if b is None:
                    hub, of, low = mine, a, -_APART * total
                elif of == a:
                    tokens, x = _difference(hub, mine)
                    f = float(x.astype(np.float64).sum()) - _APART * total
                    linked = f + low <= 1e-6
                    out.append((a, b, linked, n, f, low, i64(tokens) if n > 2 else None, x if n > 2 else None))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float32())]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["a", "b", "linked", "n", "f", "fh", "tokens", "weights"])

    members = pairs.join(bodies.withColumnRenamed("u", "b"), "b").select("a", "b", "n", "share", "body")
    hubs = pairs.select("a", "share").distinct().join(bodies.withColumnRenamed("u", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("n"), "share", "body")
    met = members.unionByName(hubs).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return met.select("a", "b", "n", "body").mapInArrow(run, _MET)


def _groups(texts: DataFrame, total: int) -> DataFrame:
    """(a, b, n, share): every text of a bucket but its hub, with the hub; n is the size of the
    largest bucket in which they met."""
    banded = texts.filter(F.size("bands") > 0).select("u", F.posexplode("bands").alias("no", "band"))
    rows = banded.select(F.xxhash64("no", "band").alias("bucket"), "u")
    sizes = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-buckets")
    members = stored(join_groups(rows, sizes, ["bucket"], "n", total), "near-members")
    degree = members.groupBy("u").agg(F.sum("n").alias("degree"))
    members = stored(members.join(degree, "u"), "near-degrees")
    most = F.max(F.struct("degree", (-F.col("u")).alias("u")))
    hubs = stored(members.groupBy("bucket", "n").agg((-most["u"]).alias("a")), "near-hubs")
    met = join_groups(members.select("bucket", F.col("u").alias("b")), hubs, ["bucket"], "n", total).filter("a <> b")
    share = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / HUB_SHARE).cast("long")).cast("int")
    return met.groupBy("a", "b").agg(F.max("n").alias("n")).withColumn("share", share)


def _open_pairs(met: DataFrame) -> DataFrame:
    """(a, b): pairs of a group that may be linked, at least one of them not to the hub."""
    several = met.filter("n > 2")
    groups = several.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.min(F.when(~F.col("linked"), F.col("f"))).alias("fo"))
    groups = stored(groups.filter("m > 1 AND fo IS NOT NULL"), "near-open")
    held = join_groups(several, groups, ["a"], "m", several.count())
    tokens = held.select(F.col("a").alias("g"), F.col("b").alias("u"), "f", "fh", "fo", "linked", F.explode(F.arrays_zip("tokens", "weights")).alias("t"))
    tokens = tokens.select("g", "u", "f", "fh", "fo", "linked", F.col("t.tokens").alias("token"), F.col("t.weights").cast("double").alias("w"))
    counts = tokens.groupBy("g", "token").agg(F.count(F.lit(1)).alias("df"), F.min("linked").alias("closed"))
    counts = stored(counts.filter("df > 1 AND NOT closed").select("g", "token", "df"), "near-tokens")
    shared = join_groups(tokens, counts, ["g", "token"], "df", max(counts.agg(F.sum("df")).first()[0] or 0, 1))
    common_first = Window.partitionBy("g", "u").orderBy(F.desc("df"), F.desc("token")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The least f that the other text of a pair can have: an open one, for a text linked to the hub.
    other = F.when(F.col("linked"), F.col("fo")).otherwise(F.col("fh"))
    left = shared.withColumn("rest", F.sum("w").over(common_first)).filter(F.col("rest") >= (F.col("f") + other) / 2 - _SLACK)
    left = stored(left.select("g", "token", "u", "f", "linked", "rest"), "near-prefixes")
    x = left.filter(~F.col("linked")).select("g", "token", F.col("u").alias("x"), F.col("f").alias("fx"), F.col("rest").alias("rx"))
    y = left.select("g", "token", F.col("u").alias("y"), F.col("f").alias("fy"), F.col("rest").alias("ry"), "linked")
    bound = (F.col("fx") + F.col("fy")) / 2 - _SLACK
    fits = (F.col("x") < F.col("y")) | (F.col("linked") & (F.col("x") != F.col("y")))
    pairs = x.join(y, ["g", "token"]).filter(fits & (F.least("rx", "ry") >= bound))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _links(texts: DataFrame, docs: DataFrame, weights) -> DataFrame:
    """All links that classes need, as (a, b) of text numbers: every pair of a bucket with a
    similarity of the threshold or more is linked itself or through the hub."""
    total = max(texts.count(), 1)
    pairs = stored(_groups(texts, total), "near-pairs")
    wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "u")
    wanted = stored(wanted.join(texts.select("u", "key", "c1", "c2"), "u"), "near-wanted")
    bodies = stored(_bodies(docs, small(wanted, wanted.count())), "near-bodies")
    met = stored(_compare(pairs, bodies, weights), "near-met")
    more = stored(_open_pairs(met).withColumn("n", F.lit(2).cast("long")).withColumn("share", F.lit(0)), "near-more")
    again = _compare(more, bodies, weights)
    return stored(met.filter("linked").select("a", "b").unionByName(again.filter("linked").select("a", "b")), "near-links")


@finished("near-result")
def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id (smallest id of the class), class_size, kept.

    Texts without words (null, empty, blank) are one class; a text of one to four words
    is only like texts of the same words.  Of a class, one row with the smallest id is
    kept; a null id sorts last; repeated rows are members of one class.  An empty table
    gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("body"))
    weights = docs.sparkSession.sparkContext.broadcast(idf(docs, "body"))
    signed = stored(_signatures(docs, weights).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    texts = signed.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.min("key").alias("key"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    texts = stored(texts.withColumn("u", F.monotonically_increasing_id()), "near-texts")
    comp = components(_links(texts, docs, weights)).withColumnRenamed("node", "u")
    rooted = stored(texts.select("u", "c1", "c2", "rep", "copies").join(comp, "u", "left").withColumn("root", F.coalesce("root", "u")), "near-rooted")
    classes = rooted.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n"))
    by_text = stored(join_groups(rooted, stored(classes, "near-classes"), ["root"], "n", texts.count()).select("c1", "c2", "root", "class_id", "class_size", "copies"), "near-by-text")
    out = stored(join_groups(signed.select("id", "row", "c1", "c2"), by_text, ["c1", "c2"], "copies", signed.count()), "near-out")
    first = out.filter(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("kept"))
    return out.join(first, "row", "left").select(F.col("id").alias(id_col), "class_id", "class_size", F.coalesce("kept", F.lit(False)).alias("kept"))
