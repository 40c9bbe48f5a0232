"""Vectorised word and n-gram hashing over Arrow text buffers (numpy only).

A *slice* is a run of whole documents laid end to end in one byte buffer. Words are maximal runs of
bytes outside ``[\\x20\\x09-\\x0D]``, which in UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` over code
points; a document boundary always ends a word. Words are hashed eight bytes at a time, all words at once; the hash of an
n-gram is a polynomial over Z/2^64 in its words' hashes, evaluated with prefix sums. No Python code runs per word, but for
those of more than ``LONG_WORD`` bytes, and what a text needs here is a small multiple of its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one slice aims at; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

#: Words of more bytes are hashed one by one.
LONG_WORD = 64

_WBASE = U(0xC2B2AE3D27D4EB4F)
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Powers that a worker keeps; those of a longer text are made for it alone.
POWERS_KEPT = 1 << 20
_pow_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(b: int) -> int:
    return pow(b, -1, 1 << 64)


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept per worker up to POWERS_KEPT and grown by doubling."""
    key = int(base)
    if key not in _pow_cache or len(_pow_cache[key][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (key, _inverse(key)):
            p = np.empty(size, np.uint64)
            p[0], filled = 1, 1
            step = b
            while filled < size:
                p[filled : 2 * filled] = p[:filled] * U(step)
                step = step * step % (1 << 64)
                filled *= 2
            out.append(p)
        if size > POWERS_KEPT:
            return out[0][:n], out[1][:n]
        _pow_cache[key] = (out[0], out[1])
    p, q = _pow_cache[key]
    return p[:n], q[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all 64 bits depend on the whole polynomial."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(29))
    h = h * U(0xA24BAED4963EE407)
    return h ^ (h >> U(32))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; of spans of one length up to 8 bytes, no two differ and agree in it."""
    size = ends - starts
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    h = size.astype(np.uint64) * U(0x9E3779B97F4A7C15) ^ U(0x5851F42D4C957F2D)
    h = (h ^ (eight[starts] & _HEAD[np.minimum(size, 8)])) * U(0xFF51AFD7ED558CCD)
    live = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at = 8
    while len(live):
        x = h[live]
        x ^= x >> U(32)
        left = size[live] - at
        h[live] = (x ^ (eight[starts[live] + at] & _HEAD[np.minimum(left, 8)])) * U(0xC4CEB9FE1A85EC53)
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return mix(h)


@dataclass
class Slice:
    """Documents [first, first + n) of a batch: their bytes, and the words in them."""

    first: int
    buf: np.ndarray  # uint8
    offsets: np.ndarray  # int64, n + 1, into buf
    starts: np.ndarray  # int64, by word
    ends: np.ndarray
    ptr: np.ndarray  # int64, n + 1: words of document i are [ptr[i], ptr[i+1])

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(_LOWER[self.buf] if lower else self.buf, self.starts, self.ends)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.ptr))


def _slice(first: int, buf: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> Slice:
    off = offsets - offsets[0]
    sp = blank[buf]
    if len(buf) == 0:
        none = np.empty(0, np.int64)
        return Slice(first, buf, off, none, none, np.zeros(len(off), np.int64))
    before, after = np.empty_like(sp), np.empty_like(sp)
    before[1:], after[:-1] = sp[:-1], sp[1:]
    inner = off[:-1][off[:-1] < len(buf)]
    before[inner] = True
    after[off[1:][off[1:] > 0] - 1] = True
    before[0] = after[-1] = True
    starts, ends = np.flatnonzero(~sp & before), np.flatnonzero(~sp & after) + 1
    return Slice(first, buf, off, starts, ends, np.searchsorted(starts, off))


def slices(texts: pa.Array | pa.ChunkedArray, slice_bytes: int = SLICE_BYTES, blank: np.ndarray = _SPACE) -> Iterator[Slice]:
    """Cut a string column into slices of whole documents; a null text counts as empty.

    ``blank`` tells for each byte whether it is between words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    _, off_buf, data = texts.buffers()
    offsets = np.frombuffer(off_buf, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield _slice(at, raw[offsets[at] : offsets[to]], offsets[at : to + 1], blank)
        at = to


def ngrams(words: np.ndarray, ptr: np.ndarray, k: int, base: np.uint64 = _WBASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows, by start word, of all documents, and the start words.

    Windows never cross a document's end; a document of fewer than k words has none.
    """
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    p, q = _powers(base, n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(words * p[:-1], out=c[1:])
    left = np.repeat(ptr[1:], np.diff(ptr)) - np.arange(n)  # words from here to the document's end
    at = np.flatnonzero(left >= k)
    return mix((c[at + k] - c[at]) * q[at] + U(k)), at


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """A mask over n words: those in a window of k words that starts at one of ``at``."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, at, 1) if len(at) < 64 else np.add(d, np.bincount(at, minlength=n + 1)[: n + 1], out=d)
    e = np.minimum(at + k, n)
    np.subtract(d, np.bincount(e, minlength=n + 1)[: n + 1], out=d)
    return np.cumsum(d[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """A mask of the keys that occur twice or more, the first occurrence included."""
    if len(keys) == 0:
        return np.zeros(0, bool)
    order = np.argsort(keys)  # equal keys in any order: several times as fast as a stable sort
    s = keys[order]
    same = s[1:] == s[:-1]
    m = np.zeros(len(keys), bool)
    m[1:] |= same
    m[:-1] |= same
    out = np.empty(len(keys), bool)
    out[order] = m
    return out


def winnow(grams: np.ndarray, at: np.ndarray, ptr: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of w consecutive n-grams of a document, the index of its smallest (leftmost on ties).

    ``grams`` and ``at`` as from ngrams(). Returns (start words of the runs, index into grams).
    Two documents that share w consecutive n-grams choose the same one in that run.
    """
    m = len(grams)
    if m < w:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ok = np.flatnonzero(at[w - 1 :] - at[: m - w + 1] == w - 1)
    end = np.repeat(ptr[1:], np.diff(ptr))
    ok = ok[end[at[ok]] == end[at[ok + w - 1]]]
    # sparse table up to the largest power of two within w
    idx = np.arange(m)
    span = 1
    best = idx
    while span * 2 <= w:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(grams[b] < grams[a], b, a)
        span *= 2
    a, b = best[ok], best[ok + w - span]
    return at[ok], np.where(grams[b] < grams[a], b, a)
