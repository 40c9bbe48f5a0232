"""License scans by patience alignment.

Texts and templates are compared as words of ASCII letters and digits (any other ASCII character parts words, letters are
lower-cased, other characters are kept), so comment marks, punctuation and line breaks don't matter. Words that occur exactly once
in both are anchors; the longest increasing subsequence of anchors is matched, and the gaps between them are aligned in the same way, down to gaps
without an anchor. A license text's coverage is its share of words that the whole text holds in order, wherever they begin and however
many other words stand between them; it is found at ``MIN_COVERAGE``, if the words that tell it from its look-alikes are among them.
A one-line notice is found whole only: its parts stand word for word, at most ``GAP`` words apart.

Of templates that match the same words the one that matches most of them counts, so that the longest explains them (of as many matched words, the one
with the greater coverage): the Lesser General Public License is not also the General one, nor a text with 'BY-NC-SA' one with 'BY-NC'.

Before an alignment exact bounds spare nearly all texts: no alignment matches more words than the text and the template
have in common with multiplicity, or than their longest common subsequence. What is left is aligned in a stretch taken from the text,
the one that first holds as many words as the whole text, as short as it can be made. Where anchors lead past the bound's alignment, that one counts.

Defined results: a null or empty text has no license; a text is scanned whole, however long; the best license is the one with the most
matched words, then the greater coverage, then the smaller name; 'All rights reserved' comes after any license; a null id comes back as null; rows that repeat are
scanned alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import documents, spread, whole_text
from .license_texts import NOTICES, RESERVED, TEXTS

MIN_COVERAGE = 0.8
#: Words that may stand between two parts of a notice.
GAP = 8
_BLANK = np.ones(256, bool)
_BLANK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The longest chain, increasing in both, of words that occur once in a and once in b."""
    na, nb = Counter(a), Counter(b)
    place = {w: i for i, w in enumerate(a) if na[w] == 1 and w >= 0}
    pairs = [(place[w], j) for j, w in enumerate(b) if nb[w] == 1 and w in place]
    # patience sorting on the places in a
    tops: list[int] = []
    heads: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):
        pile = bisect_left(tops, i)
        back.append(heads[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(i)
            heads.append(k)
        else:
            tops[pile], heads[pile] = i, k
    chain, k = [], heads[-1] if heads else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two word sequences; negative words match nothing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0] and a[a0] >= 0:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1] and a[a1 - 1] >= 0:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        chain = [(a0 + i, b0 + j) for i, j in anchors(a[a0:a1], b[b0:b1])]
        if not chain:
            continue
        out += chain
        edge_a, edge_b = a0, b0
        for i, j in [*chain, (a1, b1)]:
            if edge_a < i and edge_b < j:
                todo.append((edge_a, i, edge_b, j))
            edge_a, edge_b = i + 1, j + 1
    return sorted(out)


def _masks(b: list[int]) -> dict[int, int]:
    """The places of each word of b, as bits."""
    masks: dict[int, int] = {}
    for j, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << j
    return masks


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each word of a, the longest common subsequences with the beginnings of b: bit j is 0 where b[: j + 1] has one more than b[:j]."""
    masks, full = _masks(b), (1 << len(b)) - 1
    v = full
    for w in a:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def first_end(a: list[int], b: list[int]) -> tuple[int, int]:
    """The length of the longest common subsequence, and how many words of a are enough for it."""
    most = end = 0
    for i, v in enumerate(_rows(a, b), 1):
        if (n := len(b) - v.bit_count()) > most:
            most, end = n, i
    return most, end


def longest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The matched places of a longest common subsequence."""
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        else:
            i -= 1
    return out[::-1]


def words_of(text: str) -> np.ndarray:
    """The word hashes of one text."""
    (s,) = tk.slices(pa.array([text], pa.large_string()), blank=_BLANK)
    return s.word_hashes(lower=True)


class Scanner:
    """Templates as sequences of numbers of a common vocabulary; a name has one text or several notices."""

    def __init__(self, texts: dict[str, str], notices: dict[str, tuple[str, ...]], min_coverage: float):
        items = [(name, [text]) for name, text in sorted(texts.items())]
        items += [(name, text.split("~")) for name, all_ in sorted(notices.items()) for text in all_]
        parts = [[words_of(p.replace("*", " ")) for p in text] for _, text in items]
        self.vocab = np.unique(np.concatenate([w for p in parts for w in p]))
        self.names = [name for name, _ in items]
        self.parts = [[np.searchsorted(self.vocab, w).tolist() for w in p] for p in parts]
        self.ids = [[w for q in p for w in q] for p in self.parts]
        self.whole = np.array([k >= len(texts) for k in range(len(items))])  # notices
        self.critical = [set() if n else self._marked(text[0]) for n, (_, text) in zip(self.whole, items, strict=True)]
        share = np.where(self.whole, 1.0, min_coverage)
        self.need = np.array([max(1, -(-int(len(x) * c * 1000000) // 1000000)) for x, c in zip(self.ids, share.tolist(), strict=True)])
        self.counts = np.stack([np.bincount(x, minlength=len(self.vocab)) for x in self.ids])

    def _marked(self, text: str) -> set[int]:
        """The places of words that follow a star."""
        before = [words_of(text[:i].replace("*", " ")) for i, c in enumerate(text) if c == "*"]
        return {len(w) for w in before}

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Words as numbers, -1 outside the vocabulary."""
        at = np.searchsorted(self.vocab, hashes)
        at[at == len(self.vocab)] = 0
        return np.where(self.vocab[at] == hashes, at, -1)

    def best(self, text: list[int], t: int) -> list[int] | None:
        """The words of the text that template t matches, or None below the threshold."""
        return self._notice(text, t) if self.whole[t] else self._text(text, t)

    def _text(self, text: list[int], t: int) -> list[int] | None:
        b, need = self.ids[t], int(self.need[t])
        known = set(b)
        places = [i for i, w in enumerate(text) if w in known]  # no other word matches or parts anything
        own = [text[i] for i in places]
        most, end = first_end(own, b)
        if most < need:
            return None
        own = own[:end]
        start = end - first_end(own[::-1], b[::-1])[1]
        own = own[start:]
        m = align(own, b)
        if len(m) < most or not self.critical[t] <= {j for _, j in m}:
            m = longest(own, b)
        return [places[start + i] for i, _ in m] if self.critical[t] <= {j for _, j in m} else None

    def _notice(self, text: list[int], t: int) -> list[int] | None:
        """The first place where all parts stand word for word, in order and near each other."""
        b, parts = self.ids[t], self.parts[t]
        reach = len(b) + GAP * (len(parts) - 1)
        for e in (i for i, w in enumerate(text) if w == b[-1]):
            lo = max(0, e + 1 - reach)
            near = text[lo : e + 1]
            if not set(b) <= set(near):
                continue
            for way in (align, lambda x, y: [(len(x) - 1 - i, len(y) - 1 - j) for i, j in align(x[::-1], y[::-1])], longest):
                m = way(near, b)
                place, found, at = {j: lo + i for i, j in m}, [], 0
                for p in parts:
                    at += len(p)
                    end = place.get(at - 1, -1)
                    begin = end + 1 - len(p)
                    if end < 0 or text[max(begin, 0) : end + 1] != p or (found and not 0 < begin - found[-1] <= GAP + 1):
                        break
                    found += range(begin, end + 1)
                if len(found) == len(b):
                    return found
        return None

    def scan(self, text: np.ndarray, candidates: np.ndarray) -> list[dict]:
        """What is found in one text, best first; a text of which a better one matches half of the words is left out, and a notice of which it matches one."""
        words = text.tolist()
        found = [(t, places) for t in candidates.tolist() if (places := self.best(words, t))]
        found.sort(key=lambda x: (self.names[x[0]] == RESERVED, -len(x[1]), -len(x[1]) / len(self.ids[x[0]]), self.names[x[0]]))
        out: list[dict] = []
        taken: set[int] = set()
        for t, places in found:
            common = len(taken.intersection(places))
            if any(r["license"] == self.names[t] for r in out) or 2 * common > len(places) or (self.whole[t] and common):
                continue
            taken.update(places)
            out.append({"license": self.names[t], "coverage": round(len(places) / len(self.ids[t]), 6), "matched": len(places), "first": places[0], "last": places[-1]})
        return out

    def candidates(self, numbers: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """documents x templates: whether the words in common are enough."""
        n, v = len(ptr) - 1, len(self.vocab)
        doc = np.repeat(np.arange(n), np.diff(ptr))
        known = numbers >= 0
        table = np.bincount(doc[known] * v + numbers[known], minlength=n * v).reshape(n, v)
        out = np.zeros((n, len(self.ids)), bool)
        for t, c in enumerate(self.counts):
            own = np.flatnonzero(c)
            out[:, t] = np.minimum(table[:, own], c[own]).sum(1) >= self.need[t]
        return out


SCHEMA = "doc_id long, n_words long, license string, coverage double, found array<struct<license:string,coverage:double,matched:int,first:int,last:int>>"


def license_scan(docs: DataFrame, texts: dict[str, str] = TEXTS, notices: dict[str, tuple[str, ...]] = NOTICES, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of words, best license and its coverage, and all that were found, of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(texts, notices, min_coverage)
        item = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
        names = ["doc_id", "n_words", "license", "coverage", "found"]
        for b in batches:
            for s in tk.slices(b.column(1), blank=_BLANK):
                numbers = scanner.number(s.word_hashes(lower=True))
                may = scanner.candidates(numbers, s.ptr)
                found: list[list[dict]] = [[] for _ in range(s.n)]
                for i in np.flatnonzero(may.any(1)):
                    found[i] = scanner.scan(numbers[s.ptr[i] : s.ptr[i + 1]], np.flatnonzero(may[i]))
                top = [f[0] if f else {} for f in found]
                cols = [b.column(0).slice(s.first, s.n), pa.array(np.diff(s.ptr), pa.int64()), pa.array([x.get("license") for x in top], pa.string()), pa.array([x.get("coverage") for x in top], pa.float64()), pa.array(found, pa.list_(item))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))).mapInArrow(run, SCHEMA)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
