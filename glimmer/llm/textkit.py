"""Vectorised word splitting and hashing over Arrow string columns.

Texts are handled as one concatenated UTF-8 byte buffer per chunk.  Word and
word-window hashes are polynomial prefix sums modulo 2**64, finished with a
bijective mixer, so the cost is a few array passes per byte and no Python
object is created per word.  Such sums can collapse on long regular strings, so words
of more than ``LONG_WORD`` bytes are hashed by BLAKE2b, and nothing takes two texts or
passages for equal by these sums alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled in one set of array passes (a longer text is one chunk).
CHUNK_BYTES = 1 << 18
#: Longer words are hashed by a digest.
LONG_WORD = 64

_BASE = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_WINDOW_BASE = (0xC2B2AE3D27D4EB4F | 1, 0xA0761D6478BD642F | 1)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, _inverse(base)
        self.p = self.q = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            out = []
            for b in (self.base, self.inv):
                a = np.full(size, b, U64)
                a[0] = 1
                out.append(np.cumprod(a, dtype=U64))
            self.p, self.q = out
        return self.p[:n], self.q[:n]


_BYTE_POWERS = tuple(_Powers(b) for b in _BASE)
_WINDOW_POWERS = tuple(_Powers(b) for b in _WINDOW_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _folded_values() -> np.ndarray:
    """Letters, digits and bytes from 0x80 on are word bytes; A-Z count as a-z."""
    v = np.zeros(256, U64)
    for b in range(256):
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            v[b] = b + 1
        elif 65 <= b <= 90:
            v[b] = b + 33
    return v


def _exact_values() -> np.ndarray:
    """Everything but space and 0x09-0x0D is a word byte, unchanged."""
    v = np.arange(1, 257, dtype=U64)
    v[[32, 9, 10, 11, 12, 13]] = 0
    return v


#: Byte values by word rule; 0 separates words.
FOLDED, EXACT = _folded_values(), _exact_values()


@dataclass
class Words:
    """The words of a chunk of texts: byte spans, hashes, owner text."""

    data: np.ndarray  # bytes of the chunk
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # per text, index of its first word; one more at the end
    hashes: tuple[np.ndarray, ...]
    sums: np.ndarray | None = None  # prefix sums behind the first hash
    bounds: np.ndarray | None = None  # per text, its first byte; one more at the end

    def prefixes(self, k: int) -> np.ndarray:
        """Hash of the first k bytes of each word; 0 for shorter words."""
        _, q = _BYTE_POWERS[0].upto(len(self.sums))
        stop = np.minimum(self.start + k, len(self.sums) - 1)
        h = mix((self.sums[stop] - self.sums[self.start]) * q[self.start] + U64(k << 32))
        h[self.end - self.start < k] = 0
        return h

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether one text holds them all."""
        h = self.hashes[which]
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, bool)
        p, q = _WINDOW_POWERS[which].upto(len(h) + 1)
        s = np.zeros(len(h) + 1, U64)
        np.cumsum(h * p[: len(h)], out=s[1:])
        ok = np.ones(n, bool)
        for b in self.first[1:-1]:  # windows that cross into the next text
            ok[max(0, b - k + 1) : min(b, n)] = False
        return mix((s[k:] - s[:n]) * q[:n]), ok

    def ranges(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the words a[i] .. b[i] - 1."""
        h = self.hashes[which]
        p, q = _WINDOW_POWERS[which].upto(len(h) + 1)
        s = np.zeros(len(h) + 1, U64)
        np.cumsum(h * p[: len(h)], out=s[1:])
        return mix((s[b] - s[a]) * q[a] + (b - a).astype(U64))


def words(data: np.ndarray, bounds: np.ndarray, values: np.ndarray, hashes: int = 1) -> Words:
    """Split the texts ``data[bounds[i]:bounds[i + 1]]``; the first bound is 0."""
    n = len(data)
    v = values[data]
    inside = v != 0
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        at = bounds[:-1]
        before[at[at < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
        at = bounds[1:] - 1
        after[at[at >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    hs, sums = [], None
    for k in range(hashes):
        p, q = _BYTE_POWERS[k].upto(n + 1)
        s = np.zeros(n + 1, U64)
        np.cumsum(v * p[:n], out=s[1:])
        sums = s if sums is None else sums
        hs.append(mix((s[end] - s[start]) * q[start] + (end - start).astype(U64)))
    for i in np.flatnonzero(end - start > LONG_WORD):
        spelled = (v[start[i] : end[i]] - U64(1)).astype(np.uint8).tobytes()
        for h, x in zip(hs, np.frombuffer(hashlib.blake2b(spelled, digest_size=8 * hashes).digest(), U64), strict=True):
            h[i] = x
    return Words(data, start, end, np.searchsorted(start, bounds), tuple(hs), sums, bounds)


def chunks(column: pa.Array, values: np.ndarray, hashes: int = 1, most: int = CHUNK_BYTES):
    """Yield (first row, Words) for runs of texts of about ``most`` bytes; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, words(raw[off[i] : off[j]], off[i : j + 1] - off[i], values, hashes)
        i = j
