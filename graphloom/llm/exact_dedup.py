"""Exact deduplication over a cuckoo-filter index of live digests.

Digests (SHA-256 of the whole text) are dealt to *parts* by their leading bits. A part holds its stored
keys and a cuckoo filter over them. A batch is first reduced to one row per digest (map side, so a text that
is a third of all rows is one row before the shuffle), then every part probes its filter: a miss is new for
certain; a hit is verified against the part's stored digests, whole. The live row of a digest is the one with the
largest id. Rows that are taken out leave the log of rows; a digest without rows is deleted from the filter, and one that lost its
live row gets the largest that remains. An insertion that finds no place doubles the filter and rebuilds it from the stored keys, and
where keys outgrow the parts, all are dealt anew to more parts. State, log and a manifest lie in a folder, so that another session can
open the index and go on.

Defined results: a null text counts as empty; a text of any length is one digest; a null id is smaller than any id; of rows that repeat
both id and text, exactly one stays; taking out what was never put in changes nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RID, batches_by_id, bounded, delete, documents, list_names, materialize, read_text, scratch, union_all, whole_text, with_rid, without, write_text

#: Keys that one part holds at most, on average: bounds the memory of a task.
KEYS_PER_PART = 50_000
SLOTS, MAX_KICKS = 4, 200


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, two buckets a key (partial-key hashing)."""

    def __init__(self, log2_buckets: int, table: np.ndarray | None = None):
        self.log2 = log2_buckets
        self.mask = (1 << log2_buckets) - 1
        self.table = np.zeros((1 << log2_buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(max(2, int(np.ceil(np.log2(max(n, 1) / (0.85 * SLOTS) + 1)))))

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        t = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(t).bit_length() - 1, t)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: uint64, uniformly distributed."""
        fp = (keys >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        a = (keys & np.uint64(self.mask)).astype(np.int64)
        return fp, a, (a ^ (fp.astype(np.int64) * 0x5BD1E995)) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(keys)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def insert(self, key: int) -> bool:
        """False: no place was found, and the table is as it was before."""
        fp, a, b = (int(x[0]) for x in self._places(np.array([key], np.uint64)))
        t, undo = self.table, []
        for at in (a, b):
            free = np.flatnonzero(t[at] == 0)
            if len(free):
                t[at, free[0]] = fp
                return True
        at = b
        for kick in range(MAX_KICKS):
            slot = (key + kick) % SLOTS
            undo.append((at, slot, int(t[at, slot])))
            fp, t[at, slot] = int(t[at, slot]), fp
            at = (at ^ (fp * 0x5BD1E995)) & self.mask
            free = np.flatnonzero(t[at] == 0)
            if len(free):
                t[at, free[0]] = fp
                return True
        for at, slot, was in reversed(undo):
            t[at, slot] = was
        return False

    def insert_many(self, keys: np.ndarray) -> np.ndarray:
        """Place all keys, or return the index of the first that found no place (and those after it are not tried).

        Keys whose first bucket has room are placed together.
        """
        fp, a, _ = self._places(keys)
        order = np.argsort(a, kind="stable")
        sa = a[order]
        new = np.r_[True, sa[1:] != sa[:-1]] if len(sa) else np.zeros(0, bool)
        nth = np.arange(len(sa)) - np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0))
        used = (self.table != 0).sum(1)
        slot = used[sa] + nth
        # deletions leave holes, so a bucket's free slots are those after compaction of the row
        touched = np.unique(sa)
        rows = self.table[touched]
        self.table[touched] = np.take_along_axis(rows, np.argsort(rows == 0, axis=1, kind="stable"), axis=1)
        fits = slot < SLOTS
        self.table[sa[fits], slot[fits]] = fp[order[fits]]
        for i in order[~fits]:
            if not self.insert(int(keys[i])):
                return np.array([i], np.int64)
        return np.empty(0, np.int64)

    def remove(self, key: int) -> bool:
        fp, a, b = (int(x[0]) for x in self._places(np.array([key], np.uint64)))
        for at in (a, b):
            hit = np.flatnonzero(self.table[at] == fp)
            if len(hit):
                self.table[at, hit[0]] = 0
                return True
        return False


def _keys64(digests: list[bytes]) -> np.ndarray:
    """Bits 64..127 of each digest; the part is taken from the leading bits, so they are independent."""
    raw = b"".join([d[8:16] for d in digests])
    return np.frombuffer(raw, "<u8").astype(np.uint64)


def _grown(keys: np.ndarray, log2: int) -> CuckooFilter:
    """Overflow: a filter of twice the buckets (or more), built anew from the stored keys."""
    while True:
        f = CuckooFilter(log2)
        if not len(f.insert_many(keys)):
            return f
        log2 += 1


STATE = "part int, digest binary, keep_id long, keep_rid long, n long, filter binary, hits long, false_hits long"


def _apply(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
    """One part: probe, verify, insert, delete; sign -1 takes rows out, +1 puts them in.

    A row with sign -1 names the row that is live from now on.
    """
    part = key[0].as_py()
    digests: list[bytes | None] = []
    keep: list[tuple[int | None, int]] = []
    n: list[int] = []
    flt, hits, false_hits = None, 0, 0
    for r in old.to_pylist():
        if r["digest"] is None:
            hits, false_hits = hits + r["hits"], false_hits + r["false_hits"]
            flt = CuckooFilter.load(r["filter"]) if r["filter"] is not None else None
        else:
            digests.append(r["digest"])
            keep.append((r["keep_id"], r["keep_rid"]))
            n.append(r["n"])
    if flt is None:  # a new part, or one that was dealt anew
        flt = _grown(_keys64(digests), CuckooFilter.for_keys(len(digests) + new.num_rows).log2)
    live = {d: i for i, d in enumerate(digests)}
    rank = lambda r: (r[0] is not None, r[0] or 0, r[1])
    rows = new.to_pylist()
    k64 = _keys64([r["digest"] for r in rows])
    maybe = flt.contains(k64).tolist()
    fresh = []
    for i, (r, hit) in enumerate(zip(rows, maybe, strict=True)):
        d, row = r["digest"], (r["keep_id"], r["keep_rid"])
        at = live.get(d) if hit else None
        hits += hit
        false_hits += hit and at is None
        if r["sign"] < 0:
            if at is not None:
                n[at], keep[at] = n[at] - r["n"], row
                if n[at] <= 0:
                    flt.remove(int(k64[i]))
                    digests[at] = None
                    del live[d]
        elif at is None:
            live[d] = len(digests)
            digests.append(d)
            keep.append(row)
            n.append(r["n"])
            fresh.append(i)
        else:  # its fingerprint is there already
            n[at] += r["n"]
            keep[at] = max(keep[at], row, key=rank)
    if fresh and len(flt.insert_many(k64[fresh])):
        flt = _grown(_keys64([d for d in digests if d is not None]), flt.log2 + 1)
    out = [{"part": part, "digest": d, "keep_id": a, "keep_rid": b, "n": c} for d, (a, b), c in zip(digests, keep, n, strict=True) if d is not None]
    out.append({"part": part, "filter": flt.dump(), "hits": hits, "false_hits": false_hits})
    return pa.Table.from_pylist(out, pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in STATE.split(", ")]))


ROWS = "doc_id long, rid long, digest binary"


class CuckooIndex:
    """The live digests of all batches so far: a table of parts, replaced at each change, and the log of live rows."""

    def __init__(self, spark: SparkSession, folder: str | None = None, keys_per_part: int = KEYS_PER_PART):
        self.spark, self.folder, self.keys_per_part = spark, folder or scratch(spark, "cuckoo"), keys_per_part
        self.version, self.parts, self.keys = 0, 1, 0
        self.table: str | None = None
        self.log: list[str] = []
        found = [x for x in list_names(spark, self.folder) if x.startswith("manifest-")]
        if found:
            own = json.loads(read_text(spark, f"{self.folder}/{max(found)}"))
            self.version, self.parts, self.keys, self.table, self.log = (own[k] for k in ("version", "parts", "keys", "table", "log"))

    def state(self) -> DataFrame:
        if self.table is None:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.folder}/{self.table}")

    def rows(self) -> DataFrame:
        """(doc_id, rid, digest) of all rows that are in."""
        return union_all([self.spark.createDataFrame([], ROWS), *(self.spark.read.schema(ROWS).parquet(f"{self.folder}/{x}") for x in self.log)])

    def stored(self) -> DataFrame:
        return self.state().where("digest is not null").select("digest", "keep_id", "keep_rid", "n")

    def stats(self) -> DataFrame:
        return self.state().where("digest is null").select("part", "hits", "false_hits", F.octet_length("filter").alias("filter_bytes"))

    def _part(self) -> Column:
        return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(self.parts)).cast("int")

    def _change(self, reduced: DataFrame, sign: int, log: list[str]) -> None:
        """reduced: (digest, keep_id, keep_rid, n), a row a digest; log: the files of the rows that are in from now on."""
        old, wanted = self.state(), -(-(self.keys + reduced.count()) // self.keys_per_part)
        if wanted > self.parts:
            self.parts = max(wanted, 2 * self.parts) if self.keys else wanted
            moved = F.when(F.col("digest").isNotNull(), self._part()).otherwise(F.col("part"))
            old = old.withColumn("part", moved).withColumn("filter", F.lit(None).cast("binary"))
        new = reduced.select(self._part().alias("part"), "digest", "keep_id", "keep_rid", "n", F.lit(sign).alias("sign"))
        out = new.groupBy("part").cogroup(old.groupBy("part")).applyInArrow(_apply, STATE)
        was, name = [self.table, *(x for x in self.log if x not in log)], f"state-{self.version + 1:08d}"
        with bounded(self.spark):
            out.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}")
        self.version, self.table, self.log = self.version + 1, name, log
        self.keys = self.stored().count()
        own = {"version": self.version, "parts": self.parts, "keys": self.keys, "table": name, "log": log}
        write_text(self.spark, f"{self.folder}/manifest-{self.version:08d}", json.dumps(own))
        for x in was:
            if x:
                delete(self.spark, f"{self.folder}/{x}")

    def _logged(self, rows: DataFrame) -> str:
        name = f"rows-{self.version + 1:08d}"
        with bounded(self.spark):
            rows.select("doc_id", "rid", "digest").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return name

    def insert(self, digests: DataFrame) -> None:
        """digests: (doc_id, rid, digest)."""
        name = self._logged(digests)
        new = self.spark.read.schema(ROWS).parquet(f"{self.folder}/{name}")
        reduced = new.groupBy("digest").agg(F.max(F.struct("doc_id", "rid")).alias("m"), F.count(F.lit(1)).alias("n"))
        reduced = materialize(reduced.select("digest", F.col("m.doc_id").alias("keep_id"), F.col("m.rid").alias("keep_rid"), "n"), "batch")
        self._change(reduced, 1, [*self.log, name])

    def remove(self, digests: DataFrame) -> None:
        """Take rows out, as (doc_id, rid, digest); a digest goes when its last row does, and else its largest remaining row is live."""
        gone = digests.select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), F.col("digest").alias("k")).distinct()
        own = self.rows()
        same = (own["digest"] == gone["k"]) & (own["rid"] == gone["r"]) & own["doc_id"].eqNullSafe(gone["d"])
        out = materialize(own.join(gone, same, "left_semi"), "gone")
        left = self._logged(own.join(gone, same, "left_anti"))
        n = out.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        rest = self.spark.read.schema(ROWS).parquet(f"{self.folder}/{left}").join(n.select("digest"), "digest", "left_semi")
        best = rest.groupBy("digest").agg(F.max(F.struct("doc_id", "rid")).alias("m"))
        reduced = n.join(best, "digest", "left").select("digest", F.col("m.doc_id").alias("keep_id"), F.coalesce("m.rid", F.lit(0)).alias("keep_rid"), "n")
        self._change(materialize(reduced, "batch"), -1, [left])

    def destroy(self) -> None:
        delete(self.spark, self.folder)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, digest) of every row; rid tells rows of equal id apart."""
    return with_rid(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(RID).alias("rid"), F.unhex(F.sha2(whole_text(text_col), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, rid, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = materialize(digest_rows(docs), "digests")
    index = CuckooIndex(spark)
    for batch in batches_by_id(rows, batches):
        index.insert(batch)
    return rows.join(index.stored(), "digest").select(
        "doc_id", "rid", "keep_id", F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows that repeat another row's text; columns as they were."""
    rows = with_rid(docs)
    return without(rows, exact_dedup(rows).where("not kept")).select(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("rid")


SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""

