"""Token counts: batch encoding inside Arrow functions, returning lengths only.

The text buffer of an Arrow batch is read in windows of about ``WINDOW_BYTES`` bytes, so a batch is balanced by bytes and
a text of any length takes the memory of a window. A window is cut into *units* at safe boundaries, places that the
byte-level pre-tokeniser never joins across: where a text begins; before a space that a non-blank character follows;
within a unit that stays long, where an ASCII letter or digit meets another class of ASCII characters, and where a CJK character
meets a CJK comma or full stop. Units' tokens, laid end to end, are the text's tokens. Arrow reduces a window to its distinct
units; those that the worker has not met yet go to the library in calls balanced by bytes, and a text's
count is the sum of its units' lengths. No boundary is taken at or in an added token's string. A vocabulary with
another pre-tokeniser is encoded text by text.

Defined results: a null text counts as empty (no token, 0 bytes); texts are never truncated; rows that repeat are
counted alike; a null id comes back as null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import documents, spread, whole_text

#: Bytes of a window and of one call of the library; units that a worker remembers, about 30 bytes each.
WINDOW_BYTES, CALL_BYTES, MEMO_UNITS = 2 << 20, 1 << 18, 1_000_000
#: Longer units are not remembered: they hardly recur.
MEMO_UNIT_BYTES = 48
#: Units longer than this are cut within words' runs too.
LONG_UNIT = 256

_workers: dict[str, Encoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file: a path as it is, or a name among the public tokenizers. Every executor must see it."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """Of each byte: 0 blank or control, 1 ASCII letter, 2 ASCII digit, 3 other ASCII, 4 part of a longer character."""
    c = np.full(256, 4, np.uint8)
    c[:128] = 3
    c[:33] = 0
    c[127] = 0
    c[48:58] = 2
    c[65:91] = c[97:123] = 1
    return c


_CLASS = _classes()


def _blank_follows(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins at each place is white space (or an ASCII control character)."""
    b = [raw[np.minimum(at + k, len(raw) - 1)] for k in range(3)]
    out = _CLASS[b[0]] == 0
    out |= (b[0] == 0xC2) & ((b[1] == 0x85) | (b[1] == 0xA0))
    out |= (b[0] == 0xE1) & (b[1] == 0x9A) & (b[2] == 0x80)
    out |= (b[0] == 0xE2) & (b[1] == 0x80) & ((b[2] <= 0x8A) | (b[2] == 0xA8) | (b[2] == 0xA9) | (b[2] == 0xAF))
    out |= (b[0] == 0xE2) & (b[1] == 0x81) & (b[2] == 0x9F)
    return out | ((b[0] == 0xE3) & (b[1] == 0x80) & (b[2] == 0x80))


def _inner(raw: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """More boundaries in raw[lo:hi], one unit: between ASCII classes, and before CJK stops that follow CJK characters."""
    c = _CLASS[raw[lo:hi]]
    a, b = c[:-1], c[1:]
    ascii_ = np.flatnonzero(((a == 1) & ((b == 2) | (b == 3))) | ((a == 2) & ((b == 1) | (b == 3)))) + lo + 1
    at = np.arange(lo + 3, hi - 2)
    b0, b1, b2 = raw[at], raw[at + 1], raw[at + 2]
    stop = ((b0 == 0xE3) & (b1 == 0x80) & ((b2 == 0x81) | (b2 == 0x82))) | ((b0 == 0xEF) & (b1 == 0xBC) & ((b2 == 0x8C) | (b2 == 0x81) | (b2 == 0x9F)))
    at = at[stop]
    p0, p1 = raw[at - 3], raw[at - 2]
    letter = (p0 >= 0xE4) & (p0 <= 0xE9) & ~((p0 == 0xE4) & (p1 == 0xB7)) & ~((p0 == 0xE9) & (p1 == 0xBF))
    return np.union1d(ascii_, at[letter])


class Memo:
    """Numbers of units by two 64-bit hashes of a unit's bytes, in a large sorted run and a small one."""

    def __init__(self) -> None:
        self.runs = [np.empty((2, 0), np.uint64), np.empty((2, 0), np.uint64)]
        self.numbers = [np.empty(0, np.int32), np.empty(0, np.int32)]

    def __len__(self) -> int:
        return len(self.numbers[0]) + len(self.numbers[1])

    def find(self, key: np.ndarray) -> np.ndarray:
        """key: two rows of hashes. -1 where a unit is unknown."""
        out = np.full(key.shape[1], -1, np.int64)
        order = np.argsort(key[0])  # in order, so that the search stays within the processor's caches
        key = key[:, order]
        for run, number in zip(self.runs, self.numbers, strict=True):
            if len(number):
                at = np.minimum(np.searchsorted(run[0], key[0]), len(number) - 1)
                hit = (run[0][at] == key[0]) & (run[1][at] == key[1])
                out[order[hit]] = number[at[hit]]
        return out

    def add(self, key: np.ndarray, number: np.ndarray) -> None:
        self._merge(1, key, number)
        if 8 * len(self.numbers[1]) > len(self.numbers[0]):
            self._merge(0, self.runs[1], self.numbers[1])
            self.runs[1], self.numbers[1] = self.runs[1][:, :0], self.numbers[1][:0]

    def _merge(self, k: int, key: np.ndarray, number: np.ndarray) -> None:
        both, n = np.concatenate([self.runs[k], key], 1), np.concatenate([self.numbers[k], number])
        order = np.argsort(both[0], kind="stable")
        self.runs[k], self.numbers[k] = both[:, order], n[order]


class Encoder:
    """Lengths and ids of texts by one vocabulary file, with a bounded memory of units and their ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        added = self.lib.get_added_tokens_decoder().values()
        self.special = [t.content.encode() for t in added]
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        pre = own.get("pre_tokenizer") or {}
        plain = not any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.cuts = plain and own.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        # ids whose token begins with a space (written as U+0120): in a run of units that begin so, each begins one unit
        vocab = self.lib.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.id_type = np.uint16 if len(self.spaced) <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.memo, self.begin, self.ids = Memo(), np.zeros(1, np.int32), np.empty(0, self.id_type)

    def _boundaries(self, raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The safe places in (lo, hi), ascending; offsets: where texts begin, and the end of the last."""
        own = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")]
        if not self.cuts:
            return np.unique(own)
        at = np.flatnonzero(raw[lo:hi] == 32) + lo
        at = at[(at > lo) & (at + 1 < offsets[-1])]
        cut = np.zeros(hi - lo + 1, bool)
        cut[at[~_blank_follows(raw, at + 1)] - lo] = True
        ends = own if hi < offsets[-1] and hi not in offsets else np.append(own, hi)
        cut[ends - 1 - lo] = False  # the last space of a text is followed by nothing
        cut[own - lo] = True
        at = np.flatnonzero(cut[:-1]) + lo
        edges = np.concatenate([[lo], at, [hi]])
        long = np.flatnonzero(np.diff(edges) > LONG_UNIT)
        if len(long):
            at = np.concatenate([at, *(_inner(raw, edges[i], edges[i + 1]) for i in long)])
            at.sort()
        for s in self.special:
            text, k = raw[lo : min(hi + len(s), len(raw))].tobytes(), -1
            bad = []
            while (k := text.find(s, k + 1)) >= 0:
                bad.append(lo + k)
            for k in bad:
                at = at[(at < k - 1) | (at >= k + len(s)) | np.isin(at, own)]
        return at

    def _windows(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each window: units' first bytes, each one's number among the distinct ones, the latter's lengths, and their ids end to end."""
        _, off, data = texts.buffers()
        offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lo, end = int(offsets[0]), int(offsets[-1])
        if lo == end:
            return
        raw = np.frombuffer(data, np.uint8)
        while lo < end:
            step = WINDOW_BYTES
            while True:
                hi = min(lo + step, end)
                at = self._boundaries(raw, offsets, lo, hi)
                if hi == end or len(at):
                    break
                step *= 2
            if hi < end and hi not in offsets:
                hi, at = int(at[-1]), at[:-1]
            edges = np.concatenate([[lo], at, [hi]]).astype(np.int64)
            units = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges - lo).astype(np.int32)), pa.py_buffer(raw[lo:hi])]).dictionary_encode()
            yield edges[:-1], units.indices.to_numpy(), *self._lookup(units.dictionary)
            lo = hi

    def _lookup(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of distinct units, and their ids laid end to end."""
        cut = np.frombuffer(units.buffers()[1], np.int32)[: len(units) + 1].astype(np.int64)
        size = np.diff(cut)
        word = tk.span_hashes(np.frombuffer(units.buffers()[2], np.uint8), cut[:-1], cut[1:])
        key = np.stack([word, tk.mix(word ^ size.astype(np.uint64))])
        at = self.memo.find(key)
        new = np.flatnonzero(at < 0)
        n, ids = self._encode_units([x.decode() for x in units.take(pa.array(new)).to_pylist()])
        old = np.flatnonzero(at >= 0)
        first, length = self.begin[at[old]].astype(np.int64), np.zeros(len(units), np.int64)
        length[old], length[new] = self.begin[at[old] + 1] - first, n
        begin = np.cumsum(length) - length
        out = np.empty(int(length.sum()), self.id_type)
        for own, source, values in ((old, first, self.ids), (new, np.cumsum(n) - n, ids)):
            k = length[own]
            within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            out[np.repeat(begin[own], k) + within] = values[np.repeat(source, k) + within]
        if len(self.memo) > MEMO_UNITS or len(self.ids) > 8 * MEMO_UNITS:
            self._forget()
        short = size[new] <= MEMO_UNIT_BYTES
        kept = np.repeat(short, n)
        first = len(self.begin) - 1
        self.memo.add(key[:, new[short]], np.arange(first, first + int(short.sum()), dtype=np.int32))
        self.begin = np.concatenate([self.begin, (self.begin[-1] + np.cumsum(n[short])).astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids[kept]])
        return length, out

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of the units, and their ids laid end to end.

        Units that begin with a space are encoded in long runs and told apart by the tokens that begin with one.
        """
        step, runs, at = 64, [], 0
        while at < len(units):
            to, spaced = at + 1, self.cuts and units[at][:1] == " "
            while to < len(units) and (not spaced or to < at + step) and (self.cuts and units[to][:1] == " ") == spaced:
                to += 1
            runs.append((spaced, at, to))
            at = to
        n, parts = np.zeros(len(units), np.int64), []
        joined = self._encode(["".join(units[i:j]) for spaced, i, j in runs if spaced])
        for spaced, i, j in runs:
            if spaced:
                ids = next(joined)
                begin = np.flatnonzero(self.spaced[ids])
                if len(begin) == j - i:
                    n[i:j] = np.diff(begin, append=len(ids))
                    parts.append(ids)
                    continue
            own = list(self._encode(units[i:j]))
            n[i:j] = [len(x) for x in own]
            parts += own
        return n, np.concatenate(parts) if parts else np.empty(0, self.id_type)

    def _encode(self, items: list[str]) -> Iterator[np.ndarray]:
        """In calls of about CALL_BYTES."""
        sizes = [len(x.encode()) for x in items]
        at = 0
        while at < len(items):
            size, to = 0, at
            while to < len(items) and (to == at or size + sizes[to] <= CALL_BYTES):
                size += sizes[to]
                to += 1
            for e in self.lib.encode_batch_fast(items[at:to], add_special_tokens=False):
                yield np.array(e.ids, self.id_type)
            at = to

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        out = np.zeros(len(texts), np.int64)
        for first, unit, length, _ in self._windows(texts):
            # empty texts share a place with the next; the last text that begins there has the bytes
            doc = np.searchsorted(offsets, first, "right") - 1
            base = int(doc[0])
            n = np.bincount(doc - base, weights=length[unit]).astype(np.int64)
            out[base : base + len(n)] += n
        return out

    def encode(self, texts: pa.Array, slice_bytes: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of whole texts: number of the first, ids laid end to end, and where each text's begin (and the last ends)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1
            to = min(max(to, at + 1), len(texts))
            parts, total = [], np.zeros(to - at, np.int64)
            for first, unit, length, ids in self._windows(texts.slice(at, to - at)):
                doc = np.searchsorted(offsets[at : to + 1], first, "right") - 1
                base, n = int(doc[0]), length[unit]
                own = np.bincount(doc - base, weights=n).astype(np.int64)
                total[base : base + len(own)] += own
                ends = np.cumsum(n)
                begin = np.cumsum(length) - length
                parts.append(ids[np.arange(ends[-1]) + np.repeat(begin[unit] - ends + n, n)])
            yield at, np.concatenate(parts) if parts else np.empty(0, self.id_type), np.concatenate([[0], np.cumsum(total)])
            at = to


def encoder(path: str) -> Encoder:
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, limit: int = 512, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and n_tokens > limit, a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        for b in batches:
            n = enc.lengths(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    text = whole_text(text_col)
    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))).mapInArrow(run, SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
