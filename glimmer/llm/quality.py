"""Quality classifier from overlapping heuristic labellers.

Heuristic labellers vote bad, good or abstain on every document.  Their votes are
counted as patterns over all documents (at most 3**8 of them), and
expectation-maximisation over those counts estimates the share of bad documents
and how each labeller votes on bad and on good ones.  The posterior of a pattern
labels a bounded sample of documents, on which a linear scorer over hashed
features of word shapes is trained; that scorer alone decides on every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.llm import textkit
from glimmer.llm.common import arrow_chunks
from glimmer.llm.linear import fit, sigmoid

#: Documents, at most about, on which the scorer is trained.
SAMPLE_ROWS = 10_000
#: Hashed features of pairs of word shapes, besides the shapes themselves.
BINS = 512
SHAPES = 64
#: What tells the classes apart: a labeller objects to so many bad and so few good documents.
#: (Without these bounds the estimation calls the larger half of the documents bad; with 0.05 for
#: good ones it keeps a quarter of the bad ones of the labelled test rows.)
LEAST_RECALL, MOST_FALSE = 0.05, 0.005
#: How far a good vote counts, which clears a text of the one fault looked for.
CLEARED = 0.15
#: Words of the blocks in which distinct words are counted, so that the share does not fall with
#: the length, and least words (or runs) from which there is something to count.
BLOCK, LEAST = 200, 20
#: Bins of the shares of distinct runs and of distinct words among the features.
LEVELS = 10
#: Labellers, in the order of their votes: (statistic, bad if beyond, good if within, bad is high).
LABELLERS = (
    ("symbols", 0.05, 0.01, True),  # share of symbol bytes
    ("shouting", 0.40, 0.15, True),  # share of words in capitals
    ("pipes", 0.15, 0.02, True),  # column separators for each word
    ("stutter", 0.15, 0.03, True),  # words equal to the one before
    ("distinct_runs", 0.40, 0.80, False),  # share of distinct five-word runs
    ("distinct_words", 0.15, 0.30, False),  # share of distinct words in blocks of 200
    ("exclamations", 0.25, 0.05, True),  # exclamation marks for each word
    ("marks", 0.60, 0.30, True),  # words that end in a symbol or an exclamation mark
)

WIDTH = SHAPES + BINS + 2 * LEVELS

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"$%&*#@^~<>{}[]\\=+_`")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of per-word values by text."""
    s = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return s[first[1:]] - s[first[:-1]]


def statistics(w: textkit.Words) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """What the labellers look at, and the shape of each word."""

    def within(mask: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(mask[w.data], dtype=np.int32)])
        return s[w.end] - s[w.start]

    first, h = w.first, w.hashes[0]
    n = np.diff(first)
    at_least_one = np.maximum(n, 1)
    up, low, sym, dig = within(_UPPER), within(_LOWER), within(_SYMBOL), within(_DIGIT)
    last = w.data[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    bang = last == 33
    pipe = (w.end - w.start == 1) & (last == 124)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][n > 0]] = False
    caps = (up > 1) & (low == 0)
    symbol = sym > 0
    owner = w.owner

    def distinct(hashes: np.ndarray, part: np.ndarray, of: np.ndarray) -> np.ndarray:
        _, i = np.unique(hashes ^ textkit.mix(part.astype(np.uint64) + np.uint64(1)), return_index=True)
        return np.bincount(of[i], minlength=len(n))

    runs, ok = w.windows(5)
    at = np.flatnonzero(ok)
    n_runs = np.bincount(owner[at], minlength=len(n))
    run_share = np.where(n_runs >= LEAST, distinct(runs[at], owner[at], owner[at]) / np.maximum(n_runs, 1), np.nan)
    block = owner * (int(n.max(initial=0)) // BLOCK + 1) + (np.arange(len(h)) - first[owner]) // BLOCK
    word_share = np.where(n >= LEAST, distinct(h, block, owner) / at_least_one, np.nan)
    size = np.maximum(_per_text(w.end - w.start, first), 1)
    stats = {
        "symbols": _per_text(sym, first) / size,
        "shouting": _per_text(caps, first) / at_least_one,
        "pipes": _per_text(pipe, first) / at_least_one,
        "stutter": _per_text(same, first) / at_least_one,
        "distinct_runs": run_share,
        "distinct_words": word_share,
        "exclamations": _per_text(bang, first) / at_least_one,
        "marks": _per_text(bang | _SYMBOL[last], first) / at_least_one,
    }
    shape = caps + 2 * symbol + 4 * (dig > 0) + 8 * (bang | pipe) + 16 * same + 32 * ((up > 0) & (low > 0))
    return stats, shape.astype(np.int64)


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """2 bad, 1 good, 0 abstains; a row for each text."""
    out = []
    for name, bad, good, high in LABELLERS:
        v = stats[name]
        out.append(np.where(np.isnan(v), 0, np.where((v > bad) if high else (v < bad), 2, np.where((v < good) if high else (v > good), 1, 0))))
    return np.stack(out, 1)


def features(w: textkit.Words, stats: dict[str, np.ndarray], shape: np.ndarray) -> np.ndarray:
    """Shares of word shapes and of hashed pairs of neighbouring shapes, and how far the shares
    of distinct runs and of distinct words reach."""
    n_texts = len(w.first) - 1
    owner = w.owner
    n = np.maximum(np.diff(w.first), 1)[:, None]
    one = np.bincount(owner * SHAPES + shape, minlength=n_texts * SHAPES).reshape(n_texts, SHAPES)
    x = np.zeros((n_texts, WIDTH), np.float32)
    x[:, :SHAPES] = one / n
    if len(shape) > 1:
        pair = ((shape[:-1] * SHAPES + shape[1:]) * 2654435761 >> 7) % BINS
        inside = owner[1:] == owner[:-1]
        two = np.bincount(owner[1:][inside] * BINS + pair[inside], minlength=n_texts * BINS).reshape(n_texts, BINS)
        x[:, SHAPES : SHAPES + BINS] = two / n
    for k, name in enumerate(("distinct_runs", "distinct_words")):
        short_of = 1 - np.nan_to_num(stats[name], nan=1.0)  # what is missing from all distinct
        low = SHAPES + BINS + k * LEVELS
        x[:, low : low + LEVELS] = np.clip(short_of[:, None] * LEVELS - np.arange(LEVELS), 0, 1)
    return x


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of bad for each vote pattern, by expectation-maximisation over the counts.

    Each labeller's rates of votes on bad and on good documents are estimated, within bounds
    that fix the meaning of the two classes.  Starts from "any labeller objects".
    """
    bad, good = (patterns == 2).sum(1), (patterns == 1).sum(1)
    post = np.where(bad > 0, 0.9, np.where(good > 0, 0.05, 0.3)).astype(float)
    total = counts.sum()
    for _ in range(rounds):
        share = np.clip((post * counts).sum() / max(total, 1), 0.001, 0.6)
        logit = np.full(len(patterns), np.log(share / (1 - share)))
        for k in range(patterns.shape[1]):
            rates = []
            for q in (post * counts, (1 - post) * counts):
                c = np.array([q[patterns[:, k] == v].sum() for v in range(3)])
                rates.append((c + [0.5, 0.5, 0.05]) / (c.sum() + 1.05))
            rates[0][2], rates[1][2] = max(rates[0][2], LEAST_RECALL), min(rates[1][2], MOST_FALSE)
            # Abstaining says nothing: it comes from a lack of words.
            ratio = np.clip(np.log(rates[0] / rates[1]), [0.0, -CLEARED, -6.0], [0.0, 0.0, 6.0])
            logit += ratio[patterns[:, k]]
        new = sigmoid(logit)
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights of the scorer; its logit is that of a good document."""
    k = len(LABELLERS)
    base = 3 ** np.arange(k)

    def count(batches):
        total = np.zeros(3**k, np.int64)
        for _, w in arrow_chunks(batches, "body", textkit.EXACT):
            total += np.bincount(votes(statistics(w)[0]) @ base, minlength=3**k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pattern", "n"])

    bodies = docs.select(F.col(text_col).alias("body"))
    found = bodies.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    codes = np.array([r[0] for r in found], np.int64)
    counts = np.array([r[1] for r in found], float)
    posterior = np.full(3**k, 0.5)
    posterior[codes] = label_model(codes[:, None] // base % 3, counts) if len(codes) else 0.5
    n = int(counts.sum())

    def sampled(batches):
        for _, w in arrow_chunks(batches, "body", textkit.EXACT):
            stats, shape = statistics(w)
            x = features(w, stats, shape)
            code = votes(stats) @ base
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(code)], ["x", "pattern"])

    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("quality")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(n, 1)))
    rows = docs.filter(part).select(F.col(text_col).alias("body")).mapInArrow(sampled, "x binary, pattern long").limit(2 * sample_rows).collect()
    x = np.frombuffer(b"".join(bytes(r[0]) for r in rows), np.float32).reshape(len(rows), WIDTH)
    y = 1 - posterior[[r[1] for r in rows]] if rows else np.zeros(0)
    return fit(x, y, l2=1e-4, steps=400)


def score_chunk(w: textkit.Words, weights: np.ndarray) -> np.ndarray:
    x = features(w, *statistics(w))
    s = sigmoid(x @ weights[:-1].astype(np.float32) + weights[-1])
    return np.where(np.diff(w.first) > 0, s, 0.0)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, score (0 to 1, higher is better), kept.

    Null, empty and blank texts score 0 and are rejected; a repeated row gets the same
    score each time; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for rows, w in arrow_chunks(batches, "body", textkit.EXACT):
            s = score_chunk(w, weights).astype(np.float64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(s), pa.array(s >= 0.5)], [id_col, "score", "kept"])

    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body")).mapInArrow(run, f"{id_col} {kind}, score double, kept boolean")


def keep_good(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that the scorer keeps."""

    def run(batches):
        for rows, w in arrow_chunks(batches, text_col, textkit.EXACT):
            yield rows.filter(pa.array(score_chunk(w, weights) >= 0.5))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
