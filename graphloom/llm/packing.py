"""Best-fit packing planned on the histogram of lengths.

The planner sees counts, not documents: best-fit decreasing over at most ``capacity`` lengths, where bins of equal
free space are one entry. Each step places as many equal pieces as fit into as many equal bins, so the plan is a short
table of *slots*: (length, first rank, last rank, first sequence, offset). Pieces get a rank within their length and
take the slot of that rank. Planning is the same work for a thousand documents or for a trillion.

Defined results: a null text counts as empty (one token, the end mark); a document of more than ``capacity`` tokens is cut from its
end into whole pieces, so its first piece may be shorter; a null id comes back as null; rows that repeat are each packed, and of pieces
equal in all columns it doesn't matter which takes which slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, salted_rank, spread, whole_text
from .tokens import encoder, tokenizer_path

CAPACITY, END = 2048, 0
#: Slots of a plan that are broadcast; a longer plan (none is known) is joined by a shuffle.
BROADCAST_SLOTS = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        names = [x.split()[0] for x in PIECES.split(", ")]
        for b in batches:
            for first, ids, ends in enc.encode(b.column(1)):
                n = len(ends) - 1
                marked = np.full(len(ids) + n, END, "<u4")  # ids with the end mark after each document
                total = np.diff(ends) + 1
                begin = ends[:-1] + np.arange(n)
                marked[np.arange(len(ids)) + np.repeat(np.arange(n), total - 1)] = ids
                pieces = -(-total // capacity)
                doc = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                short = total - capacity * (pieces - 1)  # the first piece has what whole pieces leave
                start = np.where(piece > 0, short[doc] + capacity * (piece - 1), 0)
                length = np.where(piece > 0, capacity, short[doc])
                at, raw = 4 * (begin[doc] + start), memoryview(marked).cast("B")
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                columns = [b.column(0).take(pa.array(doc + first)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts: slots (length, first rank, last rank + 1, first sequence, offset)."""
    slots: list[tuple[int, int, int, int, int]] = []
    open_by: dict[int, list[tuple[int, int]]] = {}  # free space: heap of (first sequence, bins)
    frees: list[int] = []  # sorted keys of open_by
    sequences = 0

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in open_by:
                open_by[free] = []
                insort(frees, free)
            heapq.heappush(open_by[free], (first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            i = bisect_left(frees, length)
            if i < len(frees):
                free = frees[i]
                first, n = heapq.heappop(open_by[free])
                if not open_by[free]:
                    del open_by[free], frees[i]
                take = min(n, left)
                slots.append((length, rank, rank + take, first, capacity - free))
                put(free - length, first, take)
                put(free, first + take, n - take)
                rank, left = rank + take, left - take
            else:
                # a new bin is at once the best fit for the next pieces of this length
                per = capacity // length
                bins, rest = divmod(left, per)
                for k in range(per if bins else 0):
                    slots.append((length, rank + k * bins, rank + (k + 1) * bins, sequences, k * length))
                put(capacity - per * length, sequences, bins)
                rank, sequences = rank + per * bins, sequences + bins
                for k in range(rest):
                    slots.append((length, rank + k, rank + k + 1, sequences, k * length))
                if rest:
                    put(capacity - rest * length, sequences, 1)
                    sequences += 1
                left = 0
    return slots


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of docs."""
    spark = docs.sparkSession
    rows = materialize(token_pieces(docs, capacity, tokenizer), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    found = plan(histogram, capacity)
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, lo, hi, sequence, offset in found:
        by_length.setdefault(length, []).append((lo, hi, sequence, offset))
    table = [(n, [x[0] for x in s], [x[2] for x in s], [x[3] for x in s]) for n, s in ((n, sorted(s)) for n, s in by_length.items())]
    slots = spark.createDataFrame(table, "length long, lo array<long>, seq array<long>, offs array<long>")
    if len(found) <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)
    # rows equal in all of these are interchangeable
    ranked = salted_rank(rows, ["length"], ["doc_id", "piece", "start", "ids_crc32"], most=max(histogram.values(), default=0))
    # the last slot that begins at or before the rank
    at = F.expr("size(filter(lo, x -> x <= rank)) - 1")
    return ranked.join(slots, "length").withColumn("_at", at).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.expr("seq[_at]") + F.col("rank") - F.expr("lo[_at]")).alias("sequence_id"),
        F.expr("offs[_at]").alias("offset"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
