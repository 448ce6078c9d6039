"""Toxicity by weak supervision.

Voters: *lexicon* voters are words and word beginnings mined from a bounded sample
of labelled rows (a greedy cover of the toxic ones, so that every entry adds
documents of its own); *pattern* voters look at shouting, exclamation and
repetition.  A generative label model gives every voter its rates on either class
and ties it to the voter it is correlated with most within the classes, both by
expectation-maximisation.  Its posteriors label the sample; a linear classifier over the lexicon features and
pattern statistics is trained on them and scores every whole text.

Only text is an input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm import textkit
from glimmer.llm.common import arrow_chunks, stored
from glimmer.llm.linear import fit_newton, sigmoid

#: Labelled rows, at most, from which the model learns.
SAMPLE_ROWS = 20_000
#: Lexicon entries, at most, and candidates for them.
ENTRIES, CANDIDATES = 256, 20_000
#: A candidate is in so many toxic sample rows at least, and so many times likelier in them.
LEAST_TOXIC, LEAST_RATIO = 4, 20.0
#: Bytes of the word beginnings that may be entries, besides whole words.
BEGINNINGS = (7, 6, 5, 4)
PATTERNS = ("shouting", "exclaiming", "stuttering")
#: Voters are tied if their conditional mutual information, times the rows, is so much at least.
LEAST_TIE = 5.0

_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1


@dataclass
class Model:
    entries: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # of the entries, the pattern statistics and the bias


def _kinds(w: textkit.Words):
    """Feature hashes of each word, most specific first; 0 where there is none."""
    yield w.hashes[0]
    for k in BEGINNINGS:
        yield w.prefixes(k)


def _patterns(w: textkit.Words) -> np.ndarray:
    n = np.maximum(np.diff(w.first), 1)
    caps = np.concatenate([[0], np.cumsum(_UPPER[w.data])])
    up = (caps[w.end] - caps[w.start] == w.end - w.start) & (w.end - w.start > 1)
    # Neither looks beyond its own text, so that a score depends on nothing else.
    bang = np.zeros(len(w.start), bool)
    inside = w.end < w.bounds[1:][w.owner]
    bang[inside] = w.data[w.end[inside]] == 33
    same = np.zeros(len(w.start), bool)
    same[1:] = w.hashes[0][1:] == w.hashes[0][:-1]
    same[w.first[:-1][np.diff(w.first) > 0]] = False

    def share(v: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(v)])
        return (s[w.first[1:]] - s[w.first[:-1]]) / n

    return np.stack([share(up), share(bang), share(same)], 1).astype(np.float32)


def _hits(w: textkit.Words, entries: np.ndarray) -> np.ndarray:
    """(texts, entries): 1 where an entry occurs."""
    out = np.zeros((len(w.first) - 1, len(entries)), np.float32)
    if not len(entries):
        return out
    table = np.zeros(1 << 16, bool)
    table[(entries & np.uint64(0xFFFF)).astype(np.int64)] = True
    for h in _kinds(w):
        at = np.flatnonzero(table[(h & np.uint64(0xFFFF)).astype(np.int64)])
        e = np.searchsorted(entries, h[at])
        e[e == len(entries)] = 0
        ok = entries[e] == h[at]
        out[np.searchsorted(w.first, at[ok], "right") - 1, e[ok]] = 1
    return out


def _candidates(sample: DataFrame) -> np.ndarray:
    """Feature hashes that are much likelier in toxic rows, in order of their support."""

    def tally(batches):
        hs, ys = [], []
        for rows, w in arrow_chunks(batches, "body", textkit.FOLDED):
            y = rows.column(rows.schema.get_field_index("y")).to_numpy()
            owner = w.owner.astype(np.uint64)
            for h in _kinds(w):
                keep = h != 0
                u, i = np.unique(textkit.mix(h[keep] ^ textkit.mix(owner[keep] + np.uint64(1))), return_index=True)
                hs.append(h[keep][i])
                ys.append(y[owner[keep][i].astype(np.int64)])
        if hs:
            u, i = np.unique(np.concatenate(hs), return_inverse=True)
            y = np.concatenate(ys)
            toxic = np.bincount(i, y, len(u)).astype(np.int64)
            clean = np.bincount(i, 1 - y, len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(toxic), pa.array(clean)], ["h", "toxic", "clean"])

    n_toxic, n_clean = sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    if not n_toxic or not n_clean:
        return np.zeros(0, np.uint64)
    counts = sample.mapInArrow(tally, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    best = counts.filter((F.col("toxic") >= LEAST_TOXIC) & (ratio >= LEAST_RATIO)).orderBy(F.desc("toxic"), "clean", "h").limit(CANDIDATES)
    return np.array([r[0] for r in best.select("h").collect()], np.int64).view(np.uint64)


def _cover(hits: list[np.ndarray], width: int, toxic: np.ndarray) -> list[int]:
    """Greedy choice of candidates: each covers toxic rows that fewer than two chosen ones cover,
    and none says nearly the same as another.  ``hits`` are the candidates of each row."""
    cols = np.concatenate(hits)
    rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    by = np.argsort(cols, kind="stable")
    first = np.searchsorted(cols[by], np.arange(width + 1))
    rows_of = rows[by]

    def among(some: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([hits[i] for i in some] + [cols[:0]]), minlength=width)

    chosen: list[int] = []
    times = np.zeros(len(hits), np.int64)
    size = np.bincount(cols, minlength=width)
    open_ = among(np.flatnonzero(toxic))
    clean = size - open_
    usable = np.ones(width, bool)
    while len(chosen) < ENTRIES and usable.any():
        gain = (open_ - 5 * clean) * usable
        k = int(np.argmax(gain))
        if gain[k] < 3:
            break
        chosen.append(k)
        own = rows_of[first[k] : first[k + 1]]
        times[own] += 1
        open_ -= among(own[toxic[own] & (times[own] == 2)])
        usable[among(own) > 0.8 * np.maximum(size, size[k])] = False
    return chosen


def _mutual(a11: np.ndarray, n1: np.ndarray, total: float) -> np.ndarray:
    """Weighted mutual information (times the rows) of every pair of binary voters, from the
    weights of joint and single votes."""
    out = np.zeros_like(a11)
    cells = (
        (a11, n1[:, None], n1[None, :]),
        (n1[:, None] - a11, n1[:, None], total - n1[None, :]),
        (n1[None, :] - a11, total - n1[:, None], n1[None, :]),
        (total - n1[:, None] - n1[None, :] + a11, total - n1[:, None], total - n1[None, :]),
    )
    for joint, p, q in cells:
        joint = np.maximum(joint, 0)
        out += joint * np.log(np.maximum(joint, 1e-12) * total / np.maximum(p * q, 1e-12))
    return out


def _parents(gain: np.ndarray) -> np.ndarray:
    """A maximum spanning forest: each voter's parent, or -1; weak ties are left out."""
    n = len(gain)
    parent, best = np.full(n, -1), np.full(n, -np.inf)
    waiting = np.ones(n, bool)
    at = 0
    for _ in range(n):
        waiting[at] = False
        closer = waiting & (gain[at] > best)
        best[closer], parent[closer] = gain[at][closer], at
        if not waiting.any():
            break
        at = int(np.argmax(np.where(waiting, best, -np.inf)))
    parent[best < LEAST_TIE] = -1
    return parent


def label_model(votes: np.ndarray, mined: int, rounds: int = 50) -> np.ndarray:
    """Posterior of toxic for rows of votes, by expectation-maximisation of a generative model.

    A voter says toxic (1) or abstains (0), and abstaining is no evidence; but a row on which
    the first ``mined`` (lexicon) voters all abstain carries the vote of one more voter,
    silence.  Within a class, a voter's vote depends on that of at most one other, its parent in
    a maximum spanning forest of the conditional mutual information given the class; so the
    parameters are, per class, each voter's rate and, for a tied voter, its rates where the
    parent speaks and where it does not.  Voters that repeat one another then count as the one
    thing they say.  Starts from "toxic if any lexicon voter says so", so that a pattern voter
    earns its accuracy from them.
    """
    n, k = votes.shape
    votes = votes.astype(np.float64)
    quiet = ~votes[:, :mined].any(1)
    post = np.where(quiet, 0.02, 0.98)
    parent = np.full(k, -1)
    for step in range(rounds):
        share = np.clip(post.mean(), 0.001, 0.5)
        sides = []
        for q in (post, 1 - post):
            weighted = votes * q[:, None]
            sides.append((votes.T @ weighted, weighted.sum(0), q.sum(), (q * quiet).sum()))
        if step % 5 == 0:
            parent = _parents(sum(_mutual(*side[:3]) for side in sides))
        tied = np.flatnonzero(parent >= 0)
        p = parent[tied]
        rates = []
        for (both, one, total, _), seen in zip(sides, (0.2, 0.002), strict=True):
            rate = (one + seen) / (total + 2)
            # Where the parent is rarely heard, a tied voter's rates fall back on its own.
            spoken = (both[tied, p] + 2 * rate[tied]) / (one[p] + 2)
            silent = (one[tied] - both[tied, p] + 2 * rate[tied]) / (total - one[p] + 2)
            rates.append((rate, spoken, silent))
        own, spoken, silent = (np.maximum(np.log(a / b), 0.0) for a, b in zip(*rates, strict=True))
        own[tied] = 0
        said = votes[:, tied] * np.where(votes[:, p] > 0, spoken, silent)
        nothing = np.log((sides[0][3] + 0.2) / (sides[0][2] + 2)) - np.log((sides[1][3] + 0.2) / (sides[1][2] + 2))
        new = sigmoid(np.log(share / (1 - share)) + votes @ own + said.sum(1) + quiet * min(nothing, 0.0))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled rows, chosen by a hash of their id.

    Rows without a label or an id are not learned from; with no toxic or no clean row
    the lexicon is empty.
    """
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("key")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
        .orderBy(F.xxhash64(F.col("key").cast("string"), F.lit("toxicity"))).limit(sample_rows)
    )
    met = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body")).join(F.broadcast(chosen), "key")
    # One text of an id, so that repeated ids cannot make the sample larger.
    sample = stored(met.groupBy("key").agg(F.min("body").alias("body"), F.max("y").alias("y")).select("body", "y"), "toxicity-sample")
    found = _candidates(sample)
    order = np.argsort(found)
    table = found[order]

    def marked(batches):
        for rows, w in arrow_chunks(batches, "body", textkit.FOLDED):
            hits, extra = _hits(w, table), _patterns(w)
            col = [np.flatnonzero(r).astype(np.int32).tobytes() for r in hits]
            yield pa.RecordBatch.from_arrays([pa.array(col, pa.binary()), pa.array([e.tobytes() for e in extra], pa.binary()), rows.column(rows.schema.get_field_index("y"))], ["hits", "extra", "y"])

    rows = sample.mapInArrow(marked, "hits binary, extra binary, y int").collect()
    if not rows:
        return Model(np.zeros(0, np.uint64), np.append(np.zeros(len(PATTERNS)), -2.0))
    y = np.array([r[2] for r in rows])
    extra = np.stack([np.frombuffer(bytes(r[1]), np.float32) for r in rows])
    hits = [order[np.frombuffer(bytes(r[0]), np.int32)] for r in rows]  # candidates are numbered by support
    chosen_columns = sorted(_cover(hits, len(found), y == 1), key=lambda c: found[c])
    x = np.stack([np.isin(chosen_columns, h) for h in hits]).astype(np.float32)
    votes = np.concatenate([x, (extra > [0.3, 0.2, 0.2]).astype(np.float32)], 1)
    post = label_model(votes, x.shape[1])
    weights = fit_newton(np.concatenate([x, extra], 1), post, l2=1e-5)
    return Model(found[chosen_columns], weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts get the score of a text without any evidence; repeated rows
    get equal scores; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for rows, w in arrow_chunks(batches, "body", textkit.FOLDED):
            x = np.concatenate([_hits(w, model.entries), _patterns(w)], 1)
            s = sigmoid(x @ model.weights[:-1] + model.weights[-1])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body")).mapInArrow(run, f"{id_col} {kind}, score double, predicted int")
