"""Quality rules by repetition coverage.

Each slice of documents is one pass of numpy: word hashes, then for several n-gram lengths the rolling window
hashes, salted with the document's number and sorted, so that equal neighbours are windows of one document
that repeat. Measures are the share of a document's characters inside repeated n-grams (the first occurrence
included) and inside lines that equal an earlier line. Documents never meet, so nothing is shuffled.

Defined results: a null or blank text has no words and fails the base rule; one long document is a slice of its
own; an empty table gives an empty result; rows that repeat are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import documents, spread, whole_text

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """A document is kept if it passes the base rule and no measure exceeds its limit."""

    min_words: int = 20
    max_repeat_percent: int = 30  # words in repeated 8-word windows
    ngram_limits: tuple[tuple[int, float], ...] = ((3, 0.45), (5, 0.35), (10, 0.25))
    max_dup_line_chars: float = 0.30
    max_symbol_chars: float = 0.05


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, ngram_chars array<long>, base_failed boolean, kept boolean"


def _by_doc(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[ptr[1:]] - c[ptr[:-1]]


def _repeats(words: np.ndarray, ptr: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """A mask over words: those in a window of k words found twice or more in the same document."""
    g, at = tk.ngrams(words, ptr, k)
    again = tk.repeated(tk.mix(g ^ tk.mix(doc[at].astype(np.uint64) + tk.U(1))))
    return tk.covered(at[again], k, len(words))


def _lines(s: tk.Slice, words: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word that equal an earlier line, and the characters of their words.

    A line is its exact bytes between line feeds; lines without a word never count.
    """
    feed = np.flatnonzero(s.buf == 10)
    cut = np.union1d(np.union1d(feed, feed + 1), s.offsets)
    lo, hi = cut[:-1], cut[1:]
    if len(lo) == 0:
        return np.zeros(s.n, np.int64), np.zeros(s.n, np.int64)
    w0, w1 = np.searchsorted(s.starts, lo), np.searchsorted(s.starts, hi)
    some = w1 > w0
    lo, hi, w0, w1 = lo[some], hi[some], w0[some], w1[some]
    doc = np.searchsorted(s.offsets, lo, "right") - 1
    # each line by the number of its bytes among the slice's lines, and its document
    cut = np.empty(2 * len(lo) + 1, np.int64)
    cut[:-1:2], cut[1::2], cut[-1] = lo, hi, len(s.buf)
    both = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(s.buf))])
    number = both.take(pa.array(np.arange(0, len(cut) - 1, 2))).dictionary_encode().indices.to_numpy().astype(np.int64)
    key = number * (s.n + 1) + doc
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    cc = np.zeros(len(words) + 1, np.int64)
    np.cumsum(chars, out=cc[1:])
    n = np.bincount(doc[later], minlength=s.n)
    m = np.bincount(doc[later], weights=(cc[w1] - cc[w0])[later], minlength=s.n).astype(np.int64)
    return n, m


def judge(s: tk.Slice, rules: Rules) -> dict[str, np.ndarray]:
    words, doc = s.word_hashes(), s.doc_of_word()
    lead = (s.buf & 0xC0) != 0x80  # first bytes of code points
    code = np.zeros(len(s.buf) + 1, np.int64)
    np.cumsum(lead, out=code[1:])
    chars = code[s.ends] - code[s.starts]
    n_words, word_chars = np.diff(s.ptr), _by_doc(chars, s.ptr)
    symbols = _by_doc(_SYMBOL[s.buf], s.offsets)
    repeat = _by_doc(_repeats(words, s.ptr, doc, 8), s.ptr)
    dup_lines, dup_chars = _lines(s, words, chars)
    some = np.maximum(word_chars, 1)
    base = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)
    bad = (dup_chars > rules.max_dup_line_chars * some) | (symbols > rules.max_symbol_chars * some)
    grams = []
    for k, limit in rules.ngram_limits:
        inside = _by_doc(np.where(_repeats(words, s.ptr, doc, k), chars, 0), s.ptr)
        grams.append(inside)
        bad |= inside > limit * some
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat, "dup_line_chars": dup_chars, "ngram_chars": np.stack(grams, 1), "base_failed": base, "kept": ~(base | bad)}


def quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures and the verdict of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for s in tk.slices(b.column(1)):
                m = judge(s, rules)
                grams = m.pop("ngram_chars")
                arrays = {k: pa.array(v, pa.bool_() if v.dtype == bool else pa.int64()) for k, v in m.items()}
                flat = pa.array(grams.ravel(), pa.int64())
                arrays["ngram_chars"] = pa.ListArray.from_arrays(pa.array(np.arange(s.n + 1) * grams.shape[1], pa.int32()), flat)
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([ids.slice(s.first, s.n), *[arrays[n] for n in names[1:]]], names=names)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that pass, columns as they were: one narrow pass, without a join."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            if b.num_rows:
                kept = np.concatenate([judge(s, rules)["kept"] for s in tk.slices(b.column(at))])
                yield b.filter(pa.array(kept))

    return spread(docs).mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(documents(spark, sf_dir))
    chars = [F.col("ngram_chars")[i].alias(f"chars_{n}") for i, (n, _) in enumerate(Rules().ngram_limits)]
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *chars, "base_failed", "kept")


#: Windows as strings of words; covered places are counted once a length.
SQL = r"""
with w as (select doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
b as (select doc_id, t, words, len(words) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols from w),
g as (select doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') as s from b, (values (3), (5), (8), (10)) k(n), unnest(range(1, greatest(n_words - n + 2, 1))) u(i)),
c as (select distinct doc_id, n, unnest(range(i, i + n)) as p from (select *, count(*) over (partition by doc_id, n, s) as times from g) where times > 1),
r as (select c.doc_id, n, count(*) as inside, sum(length(words[p]))::bigint as chars from c join b using (doc_id) group by all),
l as (select doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as k from b),
d as (select doc_id, count(*) as n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')))::bigint as dup_line_chars
      from (select *, row_number() over (partition by doc_id, line order by k) as nth from l where regexp_matches(line, '[^\x20\x09-\x0D]')) where nth > 1 group by 1),
f as (select b.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(r8.inside, 0) as n_repeat_words, coalesce(dup_line_chars, 0) as dup_line_chars,
      coalesce(r3.chars, 0) as chars_3, coalesce(r5.chars, 0) as chars_5, coalesce(r10.chars, 0) as chars_10, greatest(word_chars, 1) as base_chars
      from b left join d using (doc_id) left join r r3 on r3.doc_id = b.doc_id and r3.n = 3 left join r r5 on r5.doc_id = b.doc_id and r5.n = 5
      left join r r8 on r8.doc_id = b.doc_id and r8.n = 8 left join r r10 on r10.doc_id = b.doc_id and r10.n = 10)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, chars_3, chars_5, chars_10,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and dup_line_chars <= 0.30::double * base_chars and n_symbols <= 0.05::double * base_chars
         and chars_3 <= 0.45::double * base_chars and chars_5 <= 0.35::double * base_chars and chars_10 <= 0.25::double * base_chars as kept
from f
"""
