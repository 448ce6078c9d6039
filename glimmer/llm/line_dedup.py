"""Duplicate and nearly equal lines by a segment-partition edit join.

Two lines are linked if their edit distance is at most ``edits``.  A line is cut into
``edits + 1`` segments; of two linked lines, the longer holds a segment of the shorter
unchanged, near its place.  So each line is indexed by its segments (number and content,
the size of which goes with the length of the line), and probes for those of every length
from its own down to ``edits`` less, at the starts that the position bounds allow.  Keys that one line alone has are
dropped by an aggregation that Spark combines map-side; the lines of the remaining keys
are compared, inside the join, by a bit-parallel recurrence over the band of diagonals that ``edits``
allows, on what is left after the common beginning and end are cut off.  Before that, two masks
of 64 bits are compared that say which pairs of neighbouring characters a line has: an edit adds
and removes at most two of them each, so more than 4 * ``edits`` different bits mean more edits.

Everything is a SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import as_text, finished, join_groups, small, stored

EDITS = 2
#: Shorter lines, in code points, are only duplicates if they are equal.
LEAST_FUZZY = 24


def _places(edits: int, residue: int) -> dict[tuple[int, int, int, int], bool]:
    """Segments that a line of length (edits + 1) * m + residue is indexed by or probes for.

    (number, coefficient and constant of the start, constant of the size) with start =
    coefficient * m + constant (from 1) and size = m + constant; True where the line itself
    is indexed by it.  Lines up to ``edits`` shorter are probed for at the offsets that
    leave no more than ``edits`` edits on either side of the segment; places that several
    lengths have in common appear once.
    """
    parts = edits + 1
    out: dict[tuple[int, int, int, int], bool] = {}
    for less in range(parts):
        borrow = int(residue < less)
        long_ones = residue - less + borrow * parts
        for i in range(1, parts + 1):
            size = int(i > parts - long_ones) - borrow
            start = 1 - (i - 1) * borrow + max(0, i - 1 - (parts - long_ones))
            for offset in range(max(1 - i, less - parts + i), min(i - 1, less + parts - i) + 1):
                place = (i, i - 1, start + offset, size)
                out[place] = out.get(place, False) or (less == 0 and offset == 0)
    return out


def signatures(line: Column, edits: int) -> Column:
    """Array of (key, indexed) of a line; keys hold the segment's number and content."""
    parts = edits + 1
    length = F.char_length(line)
    m = F.floor(length / parts).cast("int")

    def of(residue: int) -> Column:
        return F.array(*[
            F.struct(F.xxhash64(F.lit(i), F.substring(line, m * k + start, m + size)).alias("key"), F.lit(indexed).alias("indexed"))
            for (i, k, start, size), indexed in _places(edits, residue).items()
        ])

    out = of(0)
    for residue in range(1, parts):
        out = F.when(length % parts == residue, of(residue)).otherwise(out)
    return out


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, whatever the optimiser moves or repeats."""
    return F.transform(F.array(value), body)[0]


def _common(most: Column, equal) -> Column:
    """Largest n <= most with ``equal(n)``, by halving; equality holds up to it and not beyond."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(most, F.lit(1)) + 1)).cast("int"))

    def step(s: Column, _: Column) -> Column:
        def halve(mid: Column) -> Column:
            return F.when(equal(mid), F.struct(mid.alias("low"), s["high"].alias("high"))).otherwise(
                F.struct(s["low"].alias("low"), F.greatest(mid - 1, s["low"]).alias("high")))

        return _let(F.shiftright(s["low"] + s["high"] + 1, 1), halve)

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), most.cast("int").alias("high")), step, lambda s: s["low"])


def _shorter(s: Column) -> Column:
    return F.least(F.char_length(s["x"]), F.char_length(s["y"]))


def _middles(x: Column, y: Column, body) -> Column:
    """``body`` of what is left of two texts without their common beginning and end."""

    def behind(s: Column, n: Column) -> Column:
        return F.struct(*[F.substring(s[k], n + 1, F.char_length(s[k])).alias(k) for k in "xy"])

    def before(s: Column, n: Column) -> Column:
        return F.struct(*[F.left(s[k], F.char_length(s[k]) - n).alias(k) for k in "xy"])

    def ends(s: Column) -> Column:
        return _let(_common(_shorter(s), lambda n: F.right(s["x"], n) == F.right(s["y"], n)), lambda n: _let(before(s, n), body))

    both = F.struct(x.alias("x"), y.alias("y"))
    return _let(both, lambda s: _let(_common(_shorter(s), lambda n: F.left(s["x"], n) == F.left(s["y"], n)), lambda n: _let(behind(s, n), ends)))


def _characters(s: Column) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1)))
    return F.when(F.char_length(s) > 0, F.transform(at, lambda i: F.substring(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def within(x: Column, y: Column, edits: int) -> Column:
    """Whether two texts are at most ``edits`` edits apart, by a banded bit-parallel recurrence.

    Bit d of r[e], after j characters of y: they and the first j + d - edits of x are within
    e edits.  A character that matches keeps the diagonal, a substitution keeps it at one more
    edit, an insertion and a deletion move it by one.
    """
    band = 2 * edits + 1
    full = (1 << band) - 1
    start, r = [], 1 << edits
    for e in range(edits + 1):
        if e:
            r = (r | (r << 1)) & full
        start.append(F.lit(r).alias(f"r{e}"))

    def following(s: Column, match: Column) -> Column:
        fields, now = [], None
        for e in range(edits + 1):
            new = s[f"r{e}"].bitwiseAND(match)
            if e:
                before = s[f"r{e - 1}"]
                new = new.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(now, 1).bitwiseAND(full))
            now = new
            fields.append(now.alias(f"r{e}"))
        return F.struct(*fields)

    def run(z: Column) -> Column:
        n_x, n_y = F.size(z["x"]) - 2 * edits, F.size(z["y"])

        def column(s: Column, c: Column) -> Column:
            j = s["j"]
            match = F.lit(0)
            for d in range(band):
                match = match.bitwiseOR(F.when(F.get(z["x"], j + d) == c, 1 << d).otherwise(0))
            dead = s["r"][f"r{edits}"] == 0
            return F.when(dead, s).otherwise(F.struct(_let(match, lambda m: following(s["r"], m)).alias("r"), (j + 1).alias("j")))

        last = F.aggregate(z["y"], F.struct(F.struct(*start).alias("r"), F.lit(0).alias("j")), column, lambda s: s["r"][f"r{edits}"])
        at = n_x - n_y + edits
        return F.when((at >= 0) & (at < band), _let(last, lambda v: v.bitwiseAND(F.get(F.array(*[F.lit(1 << d) for d in range(band)]), at)) != 0)).otherwise(False)

    # Past its ends x has a character that no line has, so that nothing matches there.
    pad = F.array_repeat(F.lit("\n"), edits)
    return _middles(x, y, lambda s: _let(F.struct(F.concat(pad, _characters(s["x"]), pad).alias("x"), _characters(s["y"]).alias("y")), run))


def _mask(line: Column) -> Column:
    """A bit for each pair of neighbouring characters, by its hash; the end counts as one."""
    bits = _let(F.split(line, ""), lambda c: F.transform(c, lambda x, i: F.pmod(F.xxhash64(x, F.coalesce(F.get(c, i + 1), F.lit(""))), F.lit(64)).cast("int")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))


def _lines(docs: DataFrame) -> DataFrame:
    each = docs.select("id", "r", F.posexplode(F.split("body", "\n", -1)).alias("no", "line"))
    return each.filter(F.trim("line") != "")


def line_links(docs: DataFrame, edits: int = EDITS, least: int = LEAST_FUZZY) -> DataFrame:
    """(x, y): all pairs of different lines, x < y, at most ``edits`` edits apart."""
    lines = _lines(docs).select("line").filter(F.char_length("line") >= least)
    keyed = lines.select(F.xxhash64("line").alias("line_id"), F.explode(signatures(F.col("line"), edits)).alias("s"))
    keyed = stored(keyed.select("line_id", "s.key", "s.indexed"), "line-signatures")
    live = keyed.groupBy("key").agg(F.min("line_id").alias("a"), F.max("line_id").alias("b"), F.max("indexed").alias("indexed"))
    live = stored(live.filter("a <> b AND indexed").select("key"), "line-keys")
    held = stored(keyed.join(small(live, live.count()), "key").distinct(), "line-held")
    wanted = stored(held.select("line_id").distinct(), "line-wanted")
    texts = lines.withColumn("line_id", F.xxhash64("line")).join(small(wanted, wanted.count()), "line_id").distinct()
    texts = stored(texts.withColumn("mask", _mask(F.col("line"))), "line-texts")
    spelled = held.join(texts, "line_id")
    x, y = F.col("x"), F.col("y")
    probed = spelled.filter("indexed").select("key", F.col("line").alias("x"), F.col("mask").alias("mx")).join(
        spelled.select(F.col("key"), F.col("line").alias("y"), F.col("mask").alias("my"), F.col("indexed").alias("both")), "key")
    # Two lines that are indexed by one key meet twice there; once is enough.
    alike = F.bit_count(F.col("mx").bitwiseXOR(F.col("my"))) <= 4 * edits
    near = alike & (x != y) & (F.abs(F.char_length(x) - F.char_length(y)) <= edits) & (~F.col("both") | (x < y)) & within(x, y, edits)
    return stored(probed.filter(near).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "line-near")


@finished("line-result")
def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST_FUZZY) -> DataFrame:
    """One row per document: id, r (hash of id and text), n_lines, n_removed, n_links, removed.

    Lines end at ``\\n``.  Occurrences are ordered by id (nulls first), text hash and place.
    Of equal lines the first occurrence stays; a line also goes, with all its occurrences,
    if it is linked to a different line that occurs earlier.  ``removed`` lists the numbers
    (from 0) of the lines that go, ``n_links`` counts the links of the document's distinct
    lines.  Blank lines are never removed or counted.  Null and empty texts have no lines;
    input rows with the same id and text are one document; an empty table gives no rows;
    other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("body")).withColumn("r", F.xxhash64("id", "body"))
    k = F.unhex(F.md5("line")).alias("k")
    spots = stored(_lines(docs).select("id", "r", "no", k), "line-spots")
    first = F.min(F.struct("id", "r", "no")).alias("first")
    groups = spots.groupBy("k").agg(first, F.count(F.lit(1)).alias("n"))
    groups = stored(groups, "line-groups")
    links = stored(line_links(docs, edits, least).select(F.unhex(F.md5("x")).alias("a"), F.unhex(F.md5("y")).alias("b")), "line-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    order = groups.select("k", "first")
    told = both.join(order.select(F.col("k").alias("a"), F.col("first").alias("fa")), "a").join(order.select(F.col("k").alias("b"), F.col("first").alias("fb")), "b")
    told = told.groupBy(F.col("a").alias("k")).agg(F.count(F.lit(1)).alias("links"), F.max(F.col("fb") < F.col("fa")).alias("later"))
    groups = stored(groups.join(told, "k", "left").select("k", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("later", F.lit(False)).alias("later")), "line-told")
    met = join_groups(spots, groups, ["k"], "n", spots.count())
    here = F.struct("id", "r", "no")
    firsts = met.withColumn("gone", F.col("later") | ~here.eqNullSafe(F.col("first")))
    per_doc = firsts.groupBy("id", "r").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("gone").cast("long")).alias("n_removed"),
        F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("no")))).alias("removed"),
        F.aggregate(F.array_distinct(F.collect_list(F.when(F.col("links") > 0, F.struct("k", "links")))), F.lit(0).cast("long"), lambda s, x: s + x["links"]).alias("n_links"),
    )
    every = docs.select("id", "r").distinct()
    same = (F.col("d.id").eqNullSafe(F.col("p.id"))) & (F.col("d.r") == F.col("p.r"))
    out = every.alias("d").join(per_doc.alias("p"), same, "left")
    zero = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("d.id").alias(id_col), F.col("d.r").alias("r"), zero("n_lines"), zero("n_removed"), zero("n_links"), F.coalesce("p.removed", F.array().cast("array<int>")).alias("removed"))


def without_lines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows with the removed lines cut out of their texts; other columns stay, whatever
    they are called.  Rows without removed lines, null texts among them, are unchanged."""
    gone = found.filter("n_removed > 0").select(F.col(id_col).alias("id"), "r", "removed").alias("gone")
    body = as_text(F.col(f"docs.{text_col}"))
    same = F.col(f"docs.{id_col}").eqNullSafe(F.col("gone.id")) & (F.xxhash64(F.col(f"docs.{id_col}"), body) == F.col("gone.r"))
    met = docs.alias("docs").join(gone, same, "left")
    lines = F.split(body, "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone.removed"))
    left = F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")
    cut = F.when(F.col("gone.removed").isNull(), F.col(f"docs.{text_col}")).otherwise(left)
    return met.select(*[cut.alias(c) if c == text_col else F.col(f"docs.`{c}`") for c in docs.columns])
