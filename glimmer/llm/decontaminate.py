"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark window of ``size`` consecutive words (a shorter item is one
window) is a set that a document must contain whole.  For containment the
necessary prefix of a set, with its words ordered from rare to common, is its
single rarest word.  Word frequencies are counted over all documents, for the
words of the benchmark.  Documents are joined with the windows on that word; the
place of the word in the window bounds the start, the length of the document
bounds the end, and what is left is compared by a rolling hash of the window and
then word by word, byte by byte.

The benchmark is taken in blocks of at most ``block_words`` words (or one item), so what is
sent to the executors never exceeds a fixed size; every block sees every document.  Where
there are several, the hits of a block are written before the next one is sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm import textkit
from glimmer.llm.common import arrow_chunks, as_text, batch, stored

#: Words of one benchmark block (about 60 bytes each once indexed).
BLOCK_WORDS = 200_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = 1 << 18


class Block:
    """Windows of some items, indexed by their rarest word."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        self.size = size
        column = pa.array([t for _, t in items], pa.large_string())
        hs, spell, self.win = [], [], []  # windows: (item, first word, words)
        base = 0
        for i, w in textkit.chunks(column, textkit.FOLDED):
            hs.append(w.hashes[0])
            raw = w.data.tobytes().translate(_LOWER)
            spell += [raw[a:b] for a, b in zip(w.start, w.end, strict=True)]
            for d in range(len(w.first) - 1):
                a, n = int(w.first[d]), int(w.first[d + 1] - w.first[d])
                k = min(n, size)
                if k:
                    self.win += [(items[i + d][0], base + a + j, k) for j in range(n - k + 1)]
            base += len(w.start)
        self.hash = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        self.spell = spell
        self.vocabulary = np.unique(self.hash)

    def index(self, counts: np.ndarray) -> Block:
        """Order words by rarity, then by hash, and list each window under its first."""
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((self.vocabulary, counts))] = np.arange(len(counts))
        ids = np.searchsorted(self.vocabulary, self.hash)
        place = [a + int(np.argmin(rank[ids[a : a + k]])) for _, a, k in self.win]
        token = ids[place] if place else np.zeros(0, np.int64)
        order = np.argsort(token, kind="stable")
        self.by_token = np.searchsorted(token[order], np.arange(len(self.vocabulary) + 1))
        self.listed = order
        self.offset = np.array(place, np.int64) - np.array([a for _, a, _ in self.win], np.int64) if place else np.zeros(0, np.int64)
        self.length = np.array([k for _, _, k in self.win], np.int64)
        self.first = np.array([a for _, a, _ in self.win], np.int64)
        w = textkit.Words(np.zeros(0, np.uint8), np.zeros(0), np.zeros(0), np.array([0, len(self.hash)]), (self.hash,))
        self.target = np.zeros(len(self.win), np.uint64)
        for k in np.unique(self.length):
            m = self.length == k
            self.target[m] = w.windows(int(k))[0][self.first[m]]
        self.bitmap = np.zeros(_BITS, bool)
        used = np.flatnonzero(np.diff(self.by_token))
        self.bitmap[(self.vocabulary[used] & np.uint64(_BITS - 1)).astype(np.int64)] = True
        return self

    def matches(self, w: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
        """(start word, window) of every occurrence in a chunk."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = w.hashes[0]
        at = np.flatnonzero(self.bitmap[(h & np.uint64(_BITS - 1)).astype(np.int64)])
        if not len(at):
            return none
        t = np.searchsorted(self.vocabulary, h[at])
        t[t == len(self.vocabulary)] = 0
        same = self.vocabulary[t] == h[at]
        at, t = at[same], t[same]
        n = self.by_token[t + 1] - self.by_token[t]
        pos = np.repeat(at, n)
        win = self.listed[np.repeat(self.by_token[t] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        start = pos - self.offset[win]
        doc = np.searchsorted(w.first, pos, "right") - 1
        fits = (start >= w.first[doc]) & (start + self.length[win] <= w.first[doc + 1])
        start, win = start[fits], win[fits]
        good = np.zeros(len(start), bool)
        for k in np.unique(self.length[win]):
            m = self.length[win] == k
            good[m] = w.windows(int(k))[0][start[m]] == self.target[win[m]]
        start, win = start[good], win[good]
        if len(start):
            raw: dict[int, bytes] = {}

            def word(j: int) -> bytes:
                if j not in raw:
                    raw[j] = w.data[w.start[j] : w.end[j]].tobytes().translate(_LOWER)
                return raw[j]

            exact = [all(word(s + j) == self.spell[self.first[x] + j] for j in range(self.length[x])) for s, x in zip(start.tolist(), win.tolist(), strict=True)]
            start, win = start[exact], win[exact]
        return start, win


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, most: int) -> Iterator[Block]:
    """The benchmark in blocks; only one block is held at a time."""
    held, n = [], 0  # a text has no more words than half its characters
    for item, text in benchmark.select(F.col(id_col).cast("string"), as_text(text_col)).distinct().toLocalIterator():
        more = (len(text) + 1) // 2
        if held and n + more > most:
            yield Block(held, size)
            held, n = [], 0
        held.append((item if item is not None else "", text))
        n += more
    if held:
        yield Block(held, size)


def _count(docs: DataFrame, text_col: str, block) -> np.ndarray:
    """How often the words of a block occur in all documents."""

    def tally(batches):
        vocabulary = block.value.vocabulary
        bitmap = np.zeros(_BITS, bool)
        bitmap[(vocabulary & np.uint64(_BITS - 1)).astype(np.int64)] = True
        total = np.zeros(len(vocabulary), np.int64)
        for _, w in arrow_chunks(batches, text_col, textkit.FOLDED):
            h = w.hashes[0]
            h = h[bitmap[(h & np.uint64(_BITS - 1)).astype(np.int64)]]
            t = np.searchsorted(vocabulary, h)
            t[t == len(vocabulary)] = 0
            total += np.bincount(t[vocabulary[t] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["word", "n"])

    counts = np.zeros(len(block.value.vocabulary), np.int64)
    for word, n in docs.select(text_col).mapInArrow(tally, "word long, n long").groupBy("word").agg(F.sum("n")).collect():
        counts[word] = n
    return counts


def _finish(ids: list, n_words: np.ndarray, spans: list, items: list, schema: pa.Schema) -> pa.RecordBatch:
    hit, names = [], []
    for s, x in zip(spans, items, strict=True):
        total, upto = 0, 0
        for a, b in sorted(zip(s[::2], s[1::2], strict=True)):
            total += max(0, b - max(a, upto))
            upto = max(upto, b)
        hit.append(total)
        names.append(sorted(set(x)))
    return batch(schema, ids, n_words, hit, [len(x) for x in names], names, [h > 0 for h in hit])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items, contaminated.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
    Null and empty texts have no words and are not hit; an item without words has
    no window; items with one id and different texts count as one item; a null item
    id is the empty string; repeated documents get a row each; other columns of
    either table are ignored; an empty benchmark contaminates nothing.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"{id_col} {kind}, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean"
    docs = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body"))

    schema = pa.schema([(id_col, pa.null()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("contaminated", pa.bool_())])

    def finished(keys, n_words, spans: list, items: list) -> pa.RecordBatch:
        return _finish(keys, n_words, spans, items, schema.set(0, pa.field(id_col, keys.type)))

    def hits(block, w: textkit.Words) -> tuple[list[list[int]], list[list[str]]]:
        spans: list[list[int]] = [[] for _ in range(len(w.first) - 1)]
        items: list[list[str]] = [[] for _ in spans]
        if block is not None:
            start, win = block.matches(w)
            doc = np.searchsorted(w.first, start, "right") - 1
            for d, s, x in zip(doc.tolist(), start.tolist(), win.tolist(), strict=True):
                a = s - int(w.first[d])
                spans[d] += [a, a + int(block.length[x])]
                items[d].append(block.win[x][0])
        return spans, items

    def indexed(block: Block):
        counts = _count(docs, "body", held := spark.sparkContext.broadcast(block))
        held.destroy()
        return spark.sparkContext.broadcast(block.index(counts))

    found, last = None, None
    signed = docs.withColumn("sig", F.md5(as_text("body")))
    blocks = _blocks(benchmark, item_col, item_text_col, size, block_words)
    ahead = next(blocks, None)
    while ahead is not None:
        last, ahead = indexed(ahead), next(blocks, None)
        if ahead is None and found is None:
            break

        def some(batches, held=last):
            for rows, w in arrow_chunks(batches, "body", textkit.FOLDED):
                spans, items = hits(held.value, w)
                at = pa.array([bool(s) for s in spans])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["key", "sig", "spans", "items"]).filter(at)

        part = signed.mapInArrow(some, f"key {kind}, sig string, spans array<long>, items array<string>")
        part = stored(part.groupBy("key", "sig").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "leak-hits")
        found = part if found is None else found.unionByName(part)
        last.destroy()

    if found is None:

        def whole(batches):
            for rows, w in arrow_chunks(batches, "body", textkit.FOLDED):
                yield finished(rows.column(0), np.diff(w.first), *hits(last and last.value, w))

        return docs.mapInArrow(whole, out)

    # A row meets its hits, of which each block has one row for an id and a text.
    def count(batches):
        for rows, w in arrow_chunks(batches, "body", textkit.FOLDED):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(np.diff(w.first))], ["key", "sig", "n"])

    def merge(batches):
        for rows in batches:
            yield finished(rows.column(0), rows.column(1), *([x or [] for x in rows.column(k).to_pylist()] for k in (2, 3)))

    merged = found.groupBy("key", "sig").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    merged = merged.withColumnsRenamed({"key": "hit_key", "sig": "hit_sig"})
    sized = signed.mapInArrow(count, f"key {kind}, sig string, n long")
    met = sized.join(merged, F.col("key").eqNullSafe(F.col("hit_key")) & (F.col("sig") == F.col("hit_sig")), "left")
    return met.select("key", "n", "s", "i").mapInArrow(merge, out)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
