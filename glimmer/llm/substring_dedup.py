"""Removal of passages that recur anywhere, with repeated-phrase automata.

A window is ``WINDOW`` consecutive words; a word goes if a window covers it whose word
sequence also starts somewhere else.

1. Every window is represented by the smallest and by the largest hash of its
   ``GRAM``-word phrases (its anchors).  Equal windows have equal anchors, so a window can
   only recur if both do.  Anchors are counted over all documents; recurring ones fill a
   bitmap of fixed size, which only serves to leave out windows that cannot recur.
2. Runs of windows with recurring anchors are taken from the documents.  Equal runs
   are one passage with a multiplicity.
3. Passages are confirmed: one of a multiplicity of two or more recurs whole; in the
   others, windows are counted over all passages.  Passages and windows are told apart
   by 128 bits of BLAKE2b over their bytes.
4. The confirmed stretches are compiled into Aho-Corasick automata over word numbers,
   one for each shard of documents (a stretch goes to the shards whose documents may
   hold it), and the documents of the shard are streamed through: every occurrence
   that the automaton locates is removed.  Words are numbered by their bytes.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm import textkit
from glimmer.llm.common import arrow_chunks, i64, stored

WINDOW, GRAM = 35, 8
#: Bits of the anchor bitmap (16 MB) and parts of it.
FILTER_BITS, FILTER_PARTS = 1 << 27, 1024
#: Bytes of document text in one shard, about.
SHARD_BYTES = 8 << 20
#: Words of one automaton, about, and of one piece of a stretch; they are numbered by code
#: points, of which there are a million.
MOST_WORDS, PIECE = 500_000, 200_000
U64 = np.uint64


def _slide(x: np.ndarray, k: int, op) -> np.ndarray:
    """op over k consecutive values, from each on."""
    out, have = x, 1
    while have < k:
        step = min(have, k - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(w: textkit.Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(both anchors of each window, whether the window is in one text, hashes of all anchor
    places); the largest hash is given as the smallest complement."""
    h, _ = w.windows(gram)
    span = window - gram + 1
    none = np.zeros(0, U64)
    if len(h) < span:
        return none, none, np.zeros(0, bool), none
    _, ok = w.windows(window)
    lows, places = [], []
    for x in (h, ~h):
        low = _slide(x, span, np.minimum)
        padded = np.concatenate([np.zeros(span - 1, U64), np.where(ok, low, U64(0)), np.zeros(span - 1, U64)])
        lows.append(low)
        places.append(x[_slide(padded, span, np.maximum) == x])
    return lows[0], lows[1], ok, np.concatenate(places)


def _bitmap(docs: DataFrame, window: int, gram: int) -> np.ndarray:
    """Bit array of the anchors that occur at two places or more."""

    def count(batches):
        for b in batches:
            held = [anchors(w, window, gram)[3] for _, w in arrow_chunks([b], "body", textkit.EXACT)]
            h, n = np.unique(np.concatenate(held) if held else np.zeros(0, U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(i64(h)), pa.array(np.minimum(n, 2))], ["h", "n"])

    def fill(batches):
        parts: dict[int, np.ndarray] = {}
        size = FILTER_BITS // FILTER_PARTS
        for rows in batches:
            at = rows.column(0).to_numpy().view(U64) & U64(FILTER_BITS - 1)
            for part in np.unique(at // U64(size)).tolist():
                bits = parts.setdefault(int(part), np.zeros(size, bool))
                bits[(at[at // U64(size) == U64(part)] % U64(size)).astype(np.int64)] = True
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([np.packbits(b).tobytes() for b in parts.values()], pa.binary())], ["part", "bits"])

    part = F.shiftright(F.col("h").bitwiseAND(FILTER_BITS - 1), int(np.log2(FILTER_BITS // FILTER_PARTS)))
    # Each batch is combined already; dealt by part of the bitmap, the counting needs no further shuffle.
    dealt = docs.select("body").mapInArrow(count, "h long, n long").withColumn("part", part).repartition("part")
    counts = dealt.groupBy("part", "h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    size = len(out) // FILTER_PARTS
    for k, bits in counts.mapInArrow(fill, "part int, bits binary").collect():
        out[k * size : (k + 1) * size] |= np.frombuffer(bytes(bits), np.uint8)
    return out


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & U64(FILTER_BITS - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _merged(start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of the ranges [s, s + length) for sorted starts, touching ranges of one text joined
    only where they overlap or meet."""
    if not len(start):
        return start, start
    cut = np.flatnonzero(np.diff(start) > length) + 1
    return start[np.concatenate([[0], cut])], start[np.concatenate([cut - 1, [len(start) - 1]])] + length


_RUN = "array<struct<r1:long,r2:long,body:string>>"


def _opened(docs: DataFrame, bitmap, window: int, gram: int, digest: bool) -> DataFrame:
    """Documents with the runs that may recur; one without such runs is finished here."""
    run_type = pa.list_(pa.struct([("r1", pa.int64()), ("r2", pa.int64()), ("body", pa.string())]))
    kept_type = f"id {docs.schema['id'].dataType.simpleString()}, n_words long, kept string, body string, runs {_RUN}"

    def scan(batches):
        for rows, w in arrow_chunks(batches, "body", textkit.EXACT):
            low, high, ok, _ = anchors(w, window, gram)
            at = np.flatnonzero(ok)
            at = at[_in(bitmap.value, low[at])]
            at = at[_in(bitmap.value, high[at])]
            n_texts = rows.num_rows
            runs: list[list] = [[] for _ in range(n_texts)]
            if len(at):
                doc = np.searchsorted(w.first, at, "right") - 1
                edge = np.flatnonzero(np.diff(doc)) + 1
                a, b = zip(*(_merged(x, window) for x in np.split(at, edge)), strict=True)
                a, b = np.concatenate(a), np.concatenate(b)
                raw = w.data.tobytes()
                for d, s, e in zip((np.searchsorted(w.first, a, "right") - 1).tolist(), w.start[a].tolist(), w.end[b - 1].tolist(), strict=True):
                    body = b" ".join(raw[s:e].split())
                    x, y = _digests([body]).tolist()[0]
                    runs[d].append({"r1": x, "r2": y, "body": body.decode()})
            texts = rows.column(1).to_pylist()
            kept = [None if r else _out((t or "").encode().split(), digest) for r, t in zip(runs, texts, strict=True)]
            body = [t if r else None for r, t in zip(runs, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(w.first)), pa.array(kept, pa.string()), pa.array(body, pa.string()), pa.array(runs, run_type)], ["id", "n_words", "kept", "body", "runs"])

    return docs.select("id", "body").mapInArrow(scan, kept_type)


def _digests(parts) -> np.ndarray:
    """128 bits of each part's bytes, as a row of two longs."""
    held = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts])
    return np.frombuffer(held, np.int64).reshape(-1, 2)


def _out(words: list[bytes], digest: bool) -> str:
    text = b" ".join(words)
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


def _stretches(passages: DataFrame, window: int) -> DataFrame:
    """(p, text): the confirmed stretches of the passages."""

    def windows(named: bool):
        def run(batches):
            for rows in batches:
                for p, body in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    raw = body.encode()
                    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)  # a passage has single spaces
                    start, end = np.append(0, gaps + 1), np.append(gaps, len(raw))
                    n = len(start) - window + 1
                    for k in range(0, n, 1 << 18):
                        a, b = start[k : min(n, k + (1 << 18))], end[k + window - 1 : k + window - 1 + (1 << 18)]
                        both = _digests(raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True))
                        rest = [pa.array(np.full(len(a), p)), pa.array(np.arange(k, k + len(a), dtype=np.int32))] if named else []
                        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *rest], ["w1", "w2", "p", "at"][: 2 + len(rest)])

        return run

    def cut(batches):
        for rows in batches:
            out = []
            for p, body, at in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                words = body.split(" ")
                out += [(p, " ".join(words[a:b])) for a, b in zip(*_merged(np.unique(at), window), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out]) for k in range(2)], ["p", "text"])

    counted = passages.select("p", "body").mapInArrow(windows(False), "w1 long, w2 long").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"))
    counted = stored(counted.filter("c > 1").select("w1", "w2"), "phrase-windows")
    single = passages.filter("m = 1")
    found = single.select("p", "body").mapInArrow(windows(True), "w1 long, w2 long, p long, at int").join(counted, ["w1", "w2"]).groupBy("p").agg(F.collect_list("at").alias("at"))
    partial = found.join(single, "p").select("p", "body", "at").mapInArrow(cut, "p long, text string")
    return passages.filter("m > 1").select("p", F.col("body").alias("text")).unionByName(partial)


class _Automata:
    """Aho-Corasick automata over word numbers for the stretches of one shard.

    A long stretch is compiled in pieces that overlap by a window less a word: they hold the
    same windows.  An automaton has at most ``MOST_WORDS + PIECE`` different words.
    """

    def __init__(self, stretches: list[str], window: int = WINDOW, most: int = MOST_WORDS, piece: int = PIECE) -> None:
        self.parts = []
        held, size = [], 0
        for s in stretches:
            words = s.encode().split(b" ")
            for k in range(0, max(1, len(words) - window + 1), piece):
                held.append(words[k : k + piece + window - 1])
                size += len(held[-1])
                if size >= most:
                    self._add(held)
                    held, size = [], 0
        if held:
            self._add(held)

    def _add(self, stretches: list[list[bytes]]) -> None:
        numbers: dict[bytes, int] = {}
        for s in stretches:
            for x in s:
                numbers.setdefault(x, len(numbers) + 0xE000)
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s in stretches:
            machine.add_word(self._spell(numbers, s), len(s))
        machine.make_automaton()
        self.parts.append((numbers, machine))

    @staticmethod
    def _spell(numbers: dict[bytes, int], words: list[bytes]) -> str:
        """A code point for each word, past the surrogates; one not in the automaton is U+0001."""
        return np.fromiter((numbers.get(x, 1) for x in words), "<u4", len(words)).tobytes().decode("utf-32-le")

    def locate(self, words: list[bytes]) -> np.ndarray:
        """Which words any occurrence of a stretch covers."""
        edge = np.zeros(len(words) + 1, np.int64)
        for numbers, machine in self.parts:
            longest: dict[int, int] = {}
            for end, n in machine.iter(self._spell(numbers, words)):
                if n > longest.get(end, 0):
                    longest[end] = n
            if longest:
                end = np.fromiter(longest.keys(), np.int64, len(longest)) + 1
                n = np.fromiter(longest.values(), np.int64, len(longest))
                np.add.at(edge, end - n, 1)
                np.add.at(edge, end, -1)
        return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the words left, joined by one
    space, or the SHA-256 of that if ``digest``).

    Null, empty and blank texts have no words; texts shorter than a window keep all; a
    repeated row recurs and loses every window, like any copy (no occurrence is spared);
    an empty table gives no rows; other columns are ignored.
    """
    gram = min(GRAM, window)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(docs, window, gram))
    opened = stored(_opened(docs, bitmap, window, gram, digest), "phrase-documents")
    done = opened.filter("kept IS NOT NULL").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    work = opened.filter("kept IS NULL")
    size = work.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = int(max(32, -(-size // SHARD_BYTES)))
    shard = F.pmod(F.xxhash64("id", F.expr("runs[0].r1"), F.size("runs")), F.lit(shards)).cast("int")
    runs = work.select(shard.alias("shard"), F.inline("runs"))
    passages = runs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("m"), F.first("body").alias("body"))
    passages = stored(passages.withColumn("p", F.monotonically_increasing_id()), "phrase-passages")
    stretches = stored(_stretches(passages, window), "phrase-stretches")
    routed = runs.select("shard", "r1", "r2").distinct().join(passages.select("r1", "r2", "p"), ["r1", "r2"]).join(stretches, "p").select("shard", "text")
    rows = routed.select("shard", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("id"), F.col("text").alias("body")).unionByName(
        work.select(shard.alias("shard"), F.lit(1).alias("kind"), "id", "body")
    )

    def stream(batches):
        of, held, automata = None, [], None
        for rows_in in batches:
            shard_in, kinds, texts = (rows_in.column(k).to_pylist() for k in (0, 1, 3))
            ids, n_words, removed, kept = [], [], [], []
            for k, text in enumerate(texts):
                if shard_in[k] != of:
                    of, held, automata = shard_in[k], [], None
                if kinds[k] == 0:
                    held.append(text)
                    continue
                if automata is None:
                    automata, held = _Automata(held, window), []
                words = text.encode().split()
                gone = automata.locate(words)
                ids.append(k)
                n_words.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(_out([x for x, g in zip(words, gone.tolist(), strict=True) if not g] if removed[-1] else words, digest))
            if ids:
                yield pa.RecordBatch.from_arrays([rows_in.column(2).take(pa.array(ids)), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    located = dealt.mapInArrow(stream, f"id {kind}, n_words long, n_removed long, kept string")
    return done.unionByName(located).withColumnRenamed("id", id_col)
