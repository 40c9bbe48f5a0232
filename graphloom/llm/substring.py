"""Substring deduplication over a log-structured fingerprint index.

Every document is *winnowed*: of the GRAM-word hashes inside each WINDOW-word window the smallest is chosen, so two
documents that share a window share its chosen hash (the *anchor*). The index is a list of immutable runs, each a table
of (anchor, first document, last document), bucketed and sorted by anchor, a file a bucket, in a folder with a manifest: a later
session opens it and goes on. A batch becomes a run; the run is merge-joined with every older run, bucket by
bucket in the order in which both are stored (no shuffle, no sort), and anchors known to two documents
are the hits. Runs of like size are then compacted into one by another merge join; a manifest names the new run before the old ones go.

Hits are candidates only. Documents that hold one emit the windows of that anchor as 128-bit BLAKE2b digests of the window's
words, written once, and equal digests verify them: the digest's first document is the smallest id that has the window, and windows
of later documents are covered. Documents whose whole word sequence repeats are reduced to the one with the smallest id
before that, so a text that is a third of all rows is one row before the first shuffle by anchor; a copy's every window
starts in its representative.

Defined results: a null text has no words; a text shorter than a window loses nothing; a text of any length is one document; a null id is smaller than
any id; rows of equal id never remove from one another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import RID, batches_by_id, bounded, delete, documents, list_names, materialize, may_be_in, read_text, scratch, spread, union_all, whole_text, with_rid, write_text

WINDOW, GRAM = 50, 32
_NULL_ID = -(1 << 63)

SCAN = "doc_id long, rid long, ord long, n_words long, kept_sha256 string, seq binary, anchors array<long>"


def _owners(s: tk.Slice, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows' start words, and the anchor of each."""
    grams, at = tk.ngrams(s.word_hashes(), s.ptr, gram)
    start, chosen = tk.winnow(grams, at, s.ptr, window - gram + 1)
    return start, grams[chosen]


def _words(s: tk.Slice, i: int) -> bytes:
    """A document's words joined by one space."""
    return b" ".join(s.buf[s.offsets[i] : s.offsets[i + 1]].tobytes().split())


def scan(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Of each row of docs: its number of words, their digest, and its distinct anchors.

    docs: (doc_id, rid, ord, text); bytes.split() cuts at exactly the white space of a word's definition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tk.slices(b.column(3)):
                start, anchor = _owners(s, window, gram)
                at = np.searchsorted(start, s.ptr)
                sha, seq, lists, ends = [], [], [], [0]
                for i in range(s.n):
                    d = hashlib.sha256(_words(s, i))
                    sha.append(d.hexdigest())
                    seq.append(d.digest())
                    own = np.unique(anchor[at[i] : at[i + 1]])
                    lists.append(own)
                    ends.append(ends[-1] + len(own))
                flat = pa.array(np.concatenate(lists).astype(np.uint64).view(np.int64))
                cols = [b.column(k).slice(s.first, s.n) for k in range(3)]
                cols += [pa.array(np.diff(s.ptr), pa.int64()), pa.array(sha), pa.array(seq, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCAN.split(", ")])

    return spread(docs).mapInArrow(run, SCAN)


#: Bucketed tables are read in the order in which each bucket's only file is stored.
IN_ORDER = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


class FingerprintIndex:
    """Sorted runs of (anchor, first, last); first and last are the smallest and largest order number seen.

    folder: where the runs and the manifest are. If a manifest is there the index is what it says; a fresh index has as many
    buckets as the session has shuffle partitions.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or scratch(spark, "index")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, str, int]] = []  # oldest first: table, folder, rows
        self.version = 0
        found = [n for n in list_names(spark, self.folder) if n.startswith("manifest-")]
        if found:
            own = json.loads(read_text(spark, f"{self.folder}/{max(found)}"))
            self.version, self.buckets = own["version"], own["buckets"]
            for run in own["runs"]:
                name, path = f"run_{uuid.uuid4().hex}", f"{self.folder}/{run['name']}"
                spark.sql(f"CREATE TABLE {name} (anchor BIGINT, first BIGINT, last BIGINT) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{path}'")
                self.runs.append((name, path, run["rows"]))

    def _save(self) -> None:
        self.version += 1
        own = {"version": self.version, "buckets": self.buckets, "runs": [{"name": path.rsplit("/", 1)[1], "rows": n} for _, path, n in self.runs]}
        write_text(self.spark, f"{self.folder}/manifest-{self.version:08d}", json.dumps(own))

    def _write(self, rows: DataFrame) -> None:
        """rows, one for each anchor: a file a bucket, since each bucket's rows are in one task."""
        name = f"run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        rows.write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", path).option("compression", "zstd").saveAsTable(name)
        self.runs.append((name, path, self.spark.table(name).count()))

    def _drop(self, run: tuple[str, str, int]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        delete(self.spark, run[1])

    def _table(self, k: int, first: str = "first", last: str = "last") -> DataFrame:
        return self.spark.table(self.runs[k][0]).select("anchor", F.col("first").alias(first), F.col("last").alias(last))

    def _shared(self, k: int) -> DataFrame:
        """The anchors of the newest run that an older one knows of another document."""
        both = self._table(-1).hint("merge").join(self._table(k, "f", "l").hint("merge"), "anchor")
        return both.where("least(first, f) < greatest(last, l)").select("anchor")

    def ingest(self, postings: DataFrame) -> DataFrame:
        """Add a batch, (anchor, ord); returns its hits: anchors that it shares within itself or with older runs."""
        with bounded(self.spark, IN_ORDER | {"spark.sql.shuffle.partitions": str(self.buckets)}):
            self._write(postings.groupBy("anchor").agg(F.min("ord").alias("first"), F.max("ord").alias("last")))
            hits = [self._table(-1).where("first < last").select("anchor"), *(self._shared(k) for k in range(len(self.runs) - 1))]
            found = materialize(union_all(hits).distinct(), "hits")
            gone = self._compact()
        self._save()
        for run in gone:
            self._drop(run)
        return found

    def _compact(self) -> list[tuple[str, str, int]]:
        """Merge the newest runs while the newer is at least half as large as the older; returns those that are replaced."""
        gone = []
        while len(self.runs) > 1 and 2 * self.runs[-1][2] >= self.runs[-2][2]:
            x, y = self._table(-2, "f1", "l1").hint("merge"), self._table(-1, "f2", "l2").hint("merge")
            merged = x.join(y, "anchor", "full").select("anchor", F.least("f1", "f2").alias("first"), F.greatest("l1", "l2").alias("last"))
            self._write(merged)
            gone += self.runs[-3:-1]
            del self.runs[-3:-1]
        return gone

    def close(self) -> None:
        """Forget the tables of this session; runs and manifest stay."""
        while self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.runs.pop()[0]}")

    def destroy(self) -> None:
        self.close()
        delete(self.spark, self.folder)


WINDOWS = "digest binary, ord long, rid long, pos int"


def windows(candidates: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The digests of the windows whose anchor is a hit; candidates: (ord, rid, text, hits array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column(3)
            for s in tk.slices(b.column(2)):
                start, anchor = _owners(s, window, gram)
                at = np.searchsorted(start, s.ptr)
                digests, ords, rids, places = [], [], [], []
                for i in range(s.n):
                    row = s.first + i
                    own = np.asarray(hits[row].values.to_numpy(), np.int64).view(np.uint64)
                    pos = start[at[i] : at[i + 1]][np.isin(anchor[at[i] : at[i + 1]], own)] - s.ptr[i]
                    if not len(pos):
                        continue
                    text = _words(s, i)
                    gap = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                    lo = np.r_[0, gap + 1][pos].tolist()
                    hi = np.r_[gap, len(text)][pos + window - 1].tolist()
                    digests += [hashlib.blake2b(text[x:y], digest_size=16).digest() for x, y in zip(lo, hi, strict=True)]
                    ords.append(np.full(len(pos), b.column(0)[row].as_py()))
                    rids.append(np.full(len(pos), b.column(1)[row].as_py()))
                    places.append(pos)
                if digests:
                    cols = [pa.array(digests, pa.binary()), *(pa.array(np.concatenate(x), t) for x, t in ((ords, pa.int64()), (rids, pa.int64()), (places, pa.int32())))]
                    yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in WINDOWS.split(", ")])

    return candidates.select("ord", "rid", "text", "hits").mapInArrow(run, WINDOWS)


REMOVED = "rid long, ord long, n_removed long, kept_sha256 string, spans array<struct<first:int,last:int>>"


def remove(candidates: DataFrame, window: int = WINDOW) -> DataFrame:
    """What is left of documents without the windows at ``pos``; candidates: (rid, ord, text, pos array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rid", pa.int64()), ("ord", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
        for b in batches:
            out = []
            for rid, order, text, pos in zip(*[c.to_pylist() for c in b.columns], strict=True):
                words = text.encode().split()
                gone = tk.covered(np.unique(np.asarray(pos, np.int64)), window, len(words))
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                spans = [{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                out.append({"rid": rid, "ord": order, "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": spans})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return candidates.select("rid", "ord", "text", "pos").mapInArrow(run, REMOVED)


def substring_dedup(docs: DataFrame, batches: int = 2, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rid, n_words, n_removed, kept_sha256 and the removed spans (in words) of every row of docs."""
    spark = docs.sparkSession
    rows = with_rid(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(RID).alias("rid"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("ord"), whole_text(text_col).alias("text")
    )
    index, hits, scans = FingerprintIndex(spark), [], []
    for batch in batches_by_id(rows, batches):
        scanned = materialize(scan(batch, window, gram), "scan")
        # a whole sequence that repeats, in the batch or since an older one, brings its anchors once
        own = scanned.groupBy("seq").agg(F.min("ord").alias("ord"), F.min_by("anchors", "ord").alias("anchors")).where("size(anchors) > 0")
        if scans:
            own = own.join(materialize(union_all(scans).select("seq").distinct(), "known"), "seq", "left_anti")
        scans.append(scanned)
        hits.append(index.ingest(own.select(F.explode("anchors").alias("anchor"), "ord")))
    index.destroy()
    scanned = union_all(scans)
    # written tables, not aggregates, are what the joins below read, so that a hot key's rows can be split there
    firsts = materialize(scanned.groupBy("seq").agg(F.min("ord").alias("first")), "firsts")
    base = materialize(scanned.join(firsts, "seq").select("doc_id", "rid", "ord", "n_words", "kept_sha256", "first", "anchors"), "base")
    reps = base.where(F.col("ord") == F.col("first"))
    known = materialize(union_all(hits).distinct(), "hits") if len(hits) > 1 else hits[0]
    # rows by their number and their order number: two rows that agree in both are as good as impossible at any size
    held = reps.select("rid", "ord", F.explode("anchors").alias("anchor")).join(known, "anchor").groupBy("rid", "ord").agg(F.collect_list("anchor").alias("hits"))
    held = materialize(held, "held")
    candidates = materialize(may_be_in(rows.select("rid", "ord", "text"), held.select("rid")).join(held, ["rid", "ord"]), "candidates")
    found = materialize(windows(candidates, window, gram), "windows")
    first = materialize(found.groupBy("digest").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("digest", "lo"), "first")
    covered = found.join(first, "digest").where("ord > lo").groupBy("rid", "ord").agg(F.collect_list("pos").alias("pos"))
    cut = materialize(remove(candidates.select("rid", "ord", "text").join(covered, ["rid", "ord"]), window), "cut")
    out = base.drop("anchors").join(cut.withColumnRenamed("kept_sha256", "cut_sha256"), ["rid", "ord"], "left")
    copy = (F.col("ord") > F.col("first")) & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n_words") - 1).cast("int").alias("last")))
    return out.select(
        "doc_id", "rid", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>"))).alias("spans"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Windows as lists of words; a window's first document is the smallest id that has it.
SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
g as (select doc_id, i, hash(array_to_string(words[i:i + 49], ' ')) as h1, md5(array_to_string(words[i:i + 49], ' ')) as h2
      from w, unnest(range(1, len(words) - 48)) t(i) where len(words) >= 50),
f as (select h1, h2, min(doc_id) as lo from g group by all having min(doc_id) < max(doc_id)),
d as (select g.doc_id, list(g.i) as places from g join f on g.h1 = f.h1 and g.h2 = f.h2 and g.doc_id > f.lo group by all),
c as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(range(i, i + 50)) as p from (select doc_id, unnest(places) as i from d)) group by all)
select w.doc_id, len(words) as n_words, coalesce(len(gone), 0) as n_removed,
       sha256(case when gone is null then array_to_string(words, ' ') else coalesce(k.kept, '') end) as kept_sha256
from w left join c using (doc_id)
left join (select doc_id, coalesce(string_agg(word, ' ' order by p), '') as kept
           from (select w.doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from w join c using (doc_id)) x
           anti join (select doc_id, unnest(gone) as p from c) y using (doc_id, p) group by doc_id) k using (doc_id)
"""
