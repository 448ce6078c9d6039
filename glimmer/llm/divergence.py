"""Source divergence audit: which terms set a source apart from its language, and how far
the sources of a language are from each other.

Texts are read as one concatenated UTF-8 buffer.  A numpy table of 256 entries marks the bytes
of terms and folds A-Z, xxhash groups the slices between the boundaries, and every slice is
compared with the first of its group byte by byte.  Each task hands on counts by (lang, source,
term); Spark sums them.  A kept term of a language is then one sparse row, its counts by source,
and the divergences of all pairs of sources are summed over blocks of such rows with reduceat.

Nulls in text, lang and source count as empty; a row is a document, repeated rows are several.
Rows with an empty text, or without terms, still make their (lang, source) group occur.  An
empty table gives no rows.  Equal values are ranked by the UTF-8 bytes of their items.  Other
columns are not read.  All arithmetic is in integers, exact up to 9e15 terms of a language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.common import as_text, finished, stored

#: A term is kept if so many documents of its language hold it.
LEAST_DOCUMENTS = 3
#: Terms reported for each source.
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Bytes of text that are tokenized at a time; a longer text is one chunk.
CHUNK_BYTES = 1 << 21
#: Elements of the arrays of a block of sparse rows.
BLOCK = 1 << 20

COUNTS = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, source string, part string, item string, value long"


def _folded() -> np.ndarray:
    """0 for bytes between terms; letters and bytes from 0x80 stand for themselves, A-Z for a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[: 0x41] = 0
    t[0x5B:0x61] = 0
    t[0x7B:0x80] = 0
    t[0x41:0x5B] += 32
    return t


FOLDED = _folded()


def _runs(*keys: np.ndarray) -> np.ndarray:
    """The places where any of the sorted keys changes, the first included."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices of the slices start .. start + size, one slice after the other."""
    first = np.cumsum(size) - size
    return np.repeat(start - first, size) + np.arange(int(size.sum()))


def grouped_slices(data: bytes, start: np.ndarray, end: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(number of its term for each slice, first slice of each term): slices are grouped by
    their hash, and those that differ from the first of their group get numbers of their own."""
    hashes = np.fromiter(map(digest, map(data.__getitem__, map(slice, start.tolist(), end.tolist()))), np.uint64, len(start))
    order = np.argsort(hashes, kind="stable")
    begins = _runs(hashes[order])
    number = np.empty(len(start), np.int64)
    number[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    first = order[begins]
    size, like = end - start, first[number]
    wrong = size != size[like]
    same = np.flatnonzero(~wrong & (like != np.arange(len(start))))
    if len(same):
        raw = np.frombuffer(data, np.uint8)
        differs = raw[_spans(start[same], size[same])] != raw[_spans(start[like[same]], size[same])]
        wrong[same] |= np.logical_or.reduceat(differs, np.cumsum(size[same]) - size[same])
    if wrong.any():  # different terms of one hash
        known: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(wrong):
            term = data[start[i] : end[i]]
            if term not in known:
                known[term] = len(first) + len(more)
                more.append(i)
            number[i] = known[term]
        first = np.append(first, more)
    return number, first


def _tokenized(data: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, start, end, owner) of the terms of the texts between the bounds."""
    low = FOLDED[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(low))]
    begins[edge] = inside[1:-1][edge]  # no term goes on into the next text
    ends[edge - 1] = inside[1:-1][edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return low.tobytes(), start, end, np.searchsorted(bounds, start, "right") - 1


def chunk_counts(data: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of a chunk of texts, each with the number of its group."""
    low, start, end, owner = _tokenized(data, bounds)
    number, first = grouped_slices(low, start, end)
    order = np.argsort(number, kind="stable")  # owners ascend inside a term
    t, o = number[order], owner[order]
    at = _runs(t, o)
    t, g, n = t[at], group[o[at]], np.diff(np.append(at, len(order)))
    order = np.lexsort((g, t))
    t, g, n = t[order], g[order], n[order]
    at = _runs(t, g)
    if not len(at):
        none = np.zeros(0, np.int64)
        return pa.array([], pa.string()), none, none, none
    size = (end - start)[first]
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    spelled = np.frombuffer(low, np.uint8)[_spans(start[first], size)]
    terms = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(spelled)])
    return terms.take(pa.array(t[at])), g[at], np.add.reduceat(n, at), np.diff(np.append(at, len(t)))


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents by (lang, source, term).  Each group also has a row of the term
    '', which no text has, with the number of its documents."""

    def run(batches):
        for batch in batches:
            names = [batch.column(i) for i in (0, 1)]
            keys = pa.StructArray.from_arrays([c.dictionary_encode().indices for c in names], ["lang", "source"])
            pairs = np.stack([keys.field(0).to_numpy(), keys.field(1).to_numpy()], 1)
            _, one, group = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
            group = group.reshape(-1)
            lang, source = (c.take(pa.array(one)) for c in names)

            def rows(term, g, n, d, lang=lang, source=source):
                g = pa.array(g)
                return pa.RecordBatch.from_arrays([lang.take(g), source.take(g), term, pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "docs"])

            held = np.bincount(group, minlength=len(one))
            yield rows(pa.array([""] * len(one)), np.arange(len(one)), np.zeros(len(one), np.int64), held)
            text = batch.column(2).cast(pa.large_string())
            _, offsets, data = text.buffers()
            off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            i = 0
            while i < len(text):
                j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
                yield rows(*chunk_counts(raw[off[i] : off[j]], off[i : j + 1] - off[i], group[i:j]))
                i = j

    read = docs.select(as_text("lang").alias("lang"), as_text("source").alias("source"), as_text("text").alias("text"))
    return read.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), exact: long division by thousands."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class _Language:
    """The sources of a language, their totals, and the pair sums of a task."""

    def __init__(self, sources: list[str], totals: list[int], terms: int) -> None:
        self.sources = pa.array(sources, pa.string())
        self.total = np.asarray(totals, np.int64) + terms
        self.whole = int(sum(totals)) + terms
        self.absent = share(np.ones(1, np.int64), self.total)  # of a term that the source does not have
        self.sums = np.zeros((len(sources), len(sources)), np.int64)

    def add(self, row: np.ndarray, col: np.ndarray, p: np.ndarray) -> None:
        """Add what rows with an entry differ by from rows without any.  ``row`` ascends."""
        s = len(self.absent)
        ends = np.append(_runs(row)[1:], len(row))
        at = 0
        while at < len(row):  # blocks of whole rows
            fit = ends[ends <= at + max(1, BLOCK // s)]
            to = int(fit[-1]) if len(fit) and fit[-1] > at else int(ends[ends > at][0])
            r, c, v = row[at:to] - row[at], col[at:to], p[at:to]
            dense = np.tile(self.absent, (int(r[-1]) + 1, 1))
            dense[r, c] = v
            order = np.argsort(c, kind="stable")
            r, c, v = r[order], c[order], v[order][:, None]
            begins = _runs(c)
            others, mine = dense[r], self.absent[c][:, None]
            as_group = distance(v, others) - distance(mine, others)
            as_item = distance(self.absent[None, :], v) - distance(self.absent[None, :], mine)
            self.sums[c[begins]] += np.add.reduceat(as_group, begins, axis=0)
            self.sums[:, c[begins]] += np.add.reduceat(as_item, begins, axis=0).T
            at = to


def _partial(batches, languages: dict[str, tuple[list[str], list[int], int]], top: int):
    """Sums by pair of sources and the best terms of each source, of the rows of one task."""
    known: dict[str, _Language] = {}
    names = ["lang", "source", "part", "item", "value"]

    def rows(lang, source, part, item, value):
        n = len(value)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), source, pa.array([part] * n, pa.string()), item, pa.array(value, pa.int64())], names)

    for batch in batches:
        for lang in pc.unique(batch.column(0)).to_pylist():
            block = batch.filter(pc.equal(batch.column(0), lang))
            if lang not in known:
                known[lang] = _Language(*languages[lang])
            of = known[lang]
            lists = block.column(3)
            entries = lists.flatten()
            row = lists.value_parent_indices().to_numpy()
            col = pc.index_in(entries.field("source"), of.sources).to_numpy().astype(np.int64)
            p = share(entries.field("n").to_numpy() + 1, of.total[col])
            q = share(block.column(2).to_numpy() + 1, np.int64(of.whole))[row]
            of.add(row, col, p)
            above = np.flatnonzero(p > q)
            value = distance(p[above], q[above])
            terms = block.column(1)
            place = np.empty(len(terms), np.int64)
            place[pc.sort_indices(terms.cast(pa.binary())).to_numpy()] = np.arange(len(terms))
            order = np.lexsort((place[row[above]], -value, col[above]))
            c = col[above][order]
            begins = _runs(c)
            rank = np.arange(len(c)) - np.repeat(begins, np.diff(np.append(begins, len(c))))
            best = order[rank < top]
            yield rows(lang, of.sources.take(pa.array(col[above][best])), "term", terms.take(pa.array(row[above][best])), value[best])
    for lang, of in known.items():
        g, s = np.nonzero(of.sums)
        yield rows(lang, of.sources.take(pa.array(g)), "pair", of.sources.take(pa.array(s)), of.sums[g, s])


@finished("divergence")
def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    A pair's value is summed over all kept terms of the language: the value of a term that
    neither has, times the number of terms, plus what the sparse rows differ from that.  The
    totals of the (lang, source) groups go through the driver: the result itself has a row for
    each ordered pair of them.
    """
    counts = stored(term_counts(docs), "divergence-counts")
    sparse = (
        counts.filter("term <> ''").groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("entries"))
        .filter(F.col("docs") >= least).select("lang", "term", "n", "entries")
    )
    sparse = stored(sparse, "divergence-rows")
    n = sparse.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("total"))
    v = sparse.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = counts.filter("term = ''").select("lang", "source").join(n, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["total", "terms"])
    groups = stored(groups, "divergence-groups")
    languages: dict[str, tuple[list[str], list[int], int]] = {}
    for r in groups.orderBy("lang", "source").collect():
        sources, totals, _ = languages.setdefault(r["lang"], ([], [], r["terms"]))
        sources.append(r["source"])
        totals.append(r["total"])
    parts = stored(sparse.mapInArrow(lambda batches: _partial(batches, languages, top), PARTS), "divergence-parts")
    absent = F.when(F.col("terms") > 0, F.expr(f"1 + {SCALE} div (total + terms)"))
    a = groups.select("lang", "source", "terms", absent.alias("p"))
    b = groups.select("lang", F.col("source").alias("item"), absent.alias("q"))
    base = F.when(F.col("terms") > 0, F.expr("terms * ((p - q) * (p - q) div q)")).otherwise(F.lit(0))
    bases = a.join(b, "lang").filter("source <> item").select("lang", "source", "item", base.alias("value"))
    sums = parts.filter("part = 'pair' AND source <> item").select("lang", "source", "item", "value")
    pairs = bases.unionByName(sums).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = parts.filter("part = 'term'").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    out = pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms)
    return out.select("lang", "source", "part", "item", "value", "rank")
