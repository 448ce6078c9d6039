"""Secrets in texts: three base patterns and character Markov models.

Everything is a SQL expression.  Places of matches come from the lengths of the
pieces between them, in code points.  Two first-order Markov models, of random
strings and of ordinary identifiers, are counted from labelled samples; a token is a
secret where the logarithm of the likelihood ratio exceeds a threshold, or that of a
stretch of it does so by the logarithm of the token's length.  Such spans
are added only where they overlap no base span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import as_text

# The base patterns.  Runs of one class of characters with a least length are
# written with that length, which finds the same long runs as filtering all runs would.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_ASSIGNED = 12

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
TOKEN = r"[A-Za-z0-9+/_-]{12,}"
#: Logarithm of the likelihood ratio from which a token is a secret (a prior of one in 3000).
THRESHOLD = 8.0
#: Made labelled strings of either kind, and documents whose words are added as ordinary ones.
SAMPLES, SAMPLE_DOCS = 4000, 1000

# Ordinary words of identifiers.
WORDS = (
    "get set add remove update create delete find search list user account order item product customer request response "
    "service handler manager factory builder config option value index count total name type status error message event "
    "time date start end first last next previous file path directory image video page session connection database table "
    "column query result buffer stream reader writer parser token string number array object function method class module "
    "package version release build test default internal public private static global local"
).split()


def _offsets(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """Structs (start, end) of all matches, in order; ``keep`` are flags that go with them."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    flags = keep if keep is not None else F.transform(found, lambda _: F.lit(True))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["match"]
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["out"]).alias("out"))

    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("match"), flags.alias("keep"))
    places = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(pattern), places).otherwise(none)


def _base(text: Column) -> Column:
    """Structs (start, kind number, end) of the base spans."""
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= LEAST_ASSIGNED)

    def of(kind: int, places: Column) -> Column:
        return F.transform(places, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    return F.concat(of(0, _offsets(text, ASSIGN, long_enough)), of(1, _offsets(text, ACCESS)), of(2, _offsets(text, HEX)))


def _code(c: Column) -> Column:
    """Place of a character in the alphabet, from 1."""
    return F.instr(F.lit(ALPHABET), c)


def _pairs(token: Column) -> Column:
    """Numbers of the neighbouring characters of a token, from 1."""
    at = F.sequence(F.lit(1), F.char_length(token) - 1)
    return F.transform(at, lambda i: (_code(F.substring(token, i, F.lit(1))) - 1) * len(ALPHABET) + _code(F.substring(token, i + 1, F.lit(1))))


def labelled_samples(spark: SparkSession, docs: DataFrame | None = None, text_col: str = "text", samples: int = SAMPLES, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(text, random): made random strings and identifiers, and words of a bounded sample of documents."""
    rows = spark.range(samples).withColumn("d", F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)))
    b64 = F.translate(F.base64("d"), "=", "")
    random = F.when(F.col("id") % 3 == 0, F.substring(b64, 1, 40)).when(F.col("id") % 3 == 1, F.upper(F.regexp_replace(b64, "[+/]", "7"))).otherwise(F.translate(b64, "+/", "-_"))
    words = F.array(*[F.lit(w) for w in WORDS])

    def word(k: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))

    parts = [word(k) for k in range(4)]
    ordinary = F.when(F.col("id") % 5 == 0, F.concat_ws("_", *parts)).when(F.col("id") % 5 == 1, F.concat_ws("-", *parts)).when(
        F.col("id") % 5 == 2, F.concat(parts[0], *[F.initcap(p) for p in parts[1:]])).when(F.col("id") % 5 == 3, F.concat_ws("/", *parts)).otherwise(F.upper(F.concat_ws("_", *parts)))
    out = rows.select(random.alias("text"), F.lit(True).alias("random")).unionByName(rows.select(ordinary.alias("text"), F.lit(False).alias("random")))
    if docs is not None:
        # The texts with the least hashes: only hashes are sorted, and equal texts count once.
        hashed = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
        most = hashed.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
        few = hashed.filter(F.col("h") <= F.lit(most)).groupBy("h").agg(F.min("text").alias("text"))
        found = few.select(F.explode(F.regexp_extract_all(as_text("text"), F.lit(r"(?<![A-Za-z0-9])[A-Z]?[a-z]{4,}(?![A-Za-z0-9])"), F.lit(0))).alias("text"))
        out = out.unionByName(found.select("text", F.lit(False).alias("random")))
        out = out.unionByName(found.select(F.upper("text").alias("text"), F.lit(False).alias("random")))  # shouted words
    return out


def train(samples: DataFrame) -> list[float]:
    """Logarithms of the likelihood ratio of each pair of neighbouring characters."""
    n = len(ALPHABET)
    usable = samples.filter(F.col("text").rlike(r"^[A-Za-z0-9+/_-]{2,}$") & F.col("random").isNotNull())
    counts = usable.select("random", F.explode(_pairs(F.col("text"))).alias("pair")).groupBy("random", "pair").count().collect()
    seen = {True: [0] * (n * n), False: [0] * (n * n)}
    for random, pair, k in counts:
        seen[random][pair - 1] = k

    def logs(kind: bool) -> list[float]:
        out = []
        for a in range(n):
            row = seen[kind][a * n : (a + 1) * n]
            total = sum(row) + 0.5 * n
            out += [math.log((k + 0.5) / total) for k in row]
        return out

    return [r - o for r, o in zip(logs(True), logs(False), strict=True)]


def _random_spans(text: Column, ratios: list[float], threshold: float) -> Column:
    table = F.lit(ratios)

    def random(token: Column) -> Column:
        """By the whole token, or by its best stretch, which has as many places to begin as the token is long."""
        start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("run"), F.lit(0.0).alias("best"))

        def step(s: Column, p: Column) -> Column:
            x = F.element_at(table, p.cast("int"))
            run = F.greatest(s["run"] + x, F.lit(0.0))
            return F.struct((s["total"] + x).alias("total"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

        return F.aggregate(_pairs(token), start, step, lambda s: (s["total"] > threshold) | (s["best"] > threshold + F.log(F.char_length(token))))

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return _offsets(text, TOKEN, F.transform(tokens, random))


def secret_spans(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, spans: array of (start, kind, end, base), by start, then kind.

    Places are code points, the end exclusive; an assign span is the whole assignment.
    Null and empty texts have no spans; repeated rows have equal spans; an empty table gives
    no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("body"))
    rows = rows.withColumn("base", _base(F.col("body"))).withColumn("more", _random_spans(F.col("body"), ratios, threshold))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))

    def named(s: Column, base: bool, kind: Column) -> Column:
        return F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"), F.lit(base).alias("base"))

    spans = F.concat(F.transform("base", lambda s: named(s, True, s["kind"])), F.transform(free, lambda s: named(s, False, F.lit(3))))
    return rows.select(F.col("id").alias(id_col), F.array_sort(spans).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
