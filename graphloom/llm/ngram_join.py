"""Exact self-join of word-shingle sets by Jaccard similarity, with set-relation skipping.

1. *Scan*: each text's distinct shingles (64-bit hashes), their number and a 128-bit digest of the set. Equal sets become
   one node. The same pass fills a sketch of fixed size with shingle frequencies.
2. *Index lists*: a set's shingles are ordered from rare to frequent by the sketch (any common order is exact), and only
   its prefix is indexed: two sets at the threshold share a prefix shingle, and at their first one the positions i and j
   satisfy i + j <= (|x| + |y|) (1 - t) / (1 + t). Lists are split into blocks by size, so that sets too different in
   size never meet, and a block whose positions are all too large for that bound is skipped whole.
3. *Leaders*: each block's smallest node leads it. Every other member is compared with its leader only: first by parities, which
   bound the overlap from above, then by the texts, and what is kept of it is how it differs from the leader (the
   shingles it lacks and adds). Texts travel only for sets whose bound leaves something to verify: a bitmap of their row numbers, of
   bounded size whatever the corpus, spares nearly all others the shuffle.
4. *Derived answers*: sets of one leader that are at least half similar to it get their mutual overlaps from these
   differences: |x & y| = |L| - |lack x| - |lack y| + |lack x & lack y| + |add x & add y|. Two sets that the
   leader links already are not compared. Jaccard distance is a metric, so linked sets lie in the same or in neighbouring
   *rings* of width 1 - t around the leader; rings meet in cells of bounded rows and bytes, the innermost never with itself.
   A set less similar to the leader than half can only be linked to one of
   similarity at most HALF + (1 - t) to it; such pairs are listed from the blocks by size and position and verified directly.
5. Links make components.

No list's pairs are all emitted: a block gives a row a member, cells give a spanning forest.

Defined results: a text without words (or null) has no shingle and is linked with nothing; a text of fewer words than
a shingle is one shingle; a text of any length is one set; a null id is smaller than any id; rows that repeat are linked; rows that
share an id but no component are told apart by their row numbers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import RID, documents, materialize, may_be_in, spread, union_all, whole_text, with_rid, without
from .graph import components

_NULL_ID = -(1 << 63)
#: Shingles and similarity of near duplicates where no contract says otherwise.
NEAR_K, NEAR_THRESHOLD = 5, Fraction(4, 5)
#: Bits of a slot's number in the frequency sketch, by the size of the corpus within these; slots of a chunk of it.
SKETCH_BITS, CHUNK = (20, 24), 4096
#: Bytes of input for each slot of the sketch.
SLOT_INPUT = 4096
#: Members of a leader (and bytes of their differences) that meet in one cell: at most about twice this.
CELL, CELL_BYTES = 800, 8 << 20
#: Pairs of rows that one step of a cell counts.
PAIRS = 1 << 21
#: Least similarity to a leader for which differences are kept.
HALF = Fraction(1, 2)
#: Level of the compression in which texts travel.
ZSTD_LEVEL = 3

SCAN = "kind int, doc_id long, rid long, ord long, n long, digest binary, chunk int, counts binary"


def shingles(s: tk.Slice, k: int) -> list[np.ndarray]:
    """Each document's distinct shingles, sorted; ASCII letters are lower-cased."""
    words = s.word_hashes(lower=True)
    grams, at = tk.ngrams(words, s.ptr, k)
    cut = np.searchsorted(at, s.ptr)
    out = []
    for i in range(s.n):
        g = grams[cut[i] : cut[i + 1]]
        if not len(g) and s.ptr[i + 1] > s.ptr[i]:
            w = words[s.ptr[i] : s.ptr[i + 1]]
            g, _ = tk.ngrams(w, np.array([0, len(w)]), len(w))
        out.append(np.unique(g))
    return out


def sketch_bits(rows: DataFrame) -> int:
    """Larger sketches for larger inputs, so that frequent shingles stand out; any order of shingles gives the same links."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max((size // SLOT_INPUT).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> tk.U(65 - slots.bit_length())).astype(np.int64)


def scan(rows: DataFrame, k: int, bits: int) -> DataFrame:
    """kind 0: a row's set; kind 1: a chunk of the task's sketch. rows: (doc_id, rid, ord, text)."""
    slots = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in SCAN.split(", ")])
        sketch = np.zeros(slots, np.uint32)
        for b in batches:
            for s in tk.slices(b.column(3)):
                sets = shingles(s, k)
                np.add.at(sketch, _slot(np.concatenate(sets), slots), np.uint32(1))
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                none = pa.nulls(s.n)
                cols = [pa.array(np.zeros(s.n, np.int32)), *(b.column(i).slice(s.first, s.n) for i in range(3)), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
        if sketch.any():
            rows = [{"kind": 1, "chunk": c, "counts": sketch[c * CHUNK : (c + 1) * CHUNK].tobytes()} for c in range(slots // CHUNK)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spread(rows).mapInArrow(run, SCAN)


def ranks(scanned: DataFrame, bits: int) -> np.ndarray:
    """The frequency class (a quarter of an octave) of each slot: a byte each, 16 MB at most, for the driver and all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.setdefault(c, np.zeros(CHUNK, np.uint64))
                total[c] += np.frombuffer(raw, np.uint32)
        classes = lambda x: (4 * np.log2(x + 1.0)).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_pylist([{"chunk": c, "counts": classes(x)} for c, x in total.items()], pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))

    out = np.zeros(1 << bits, np.uint8)
    chunks = (1 << bits) // CHUNK
    parts = scanned.where("kind = 1").select("chunk", "counts").repartition(min(16, chunks), "chunk").mapInArrow(run, "chunk int, counts binary")
    for r in parts.collect():  # `chunks` rows
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint8)
    return out


def prefix_length(n: int, t: Fraction) -> int:
    return n - -(-n * t.numerator // t.denominator) + 1


def prefixes(rows: DataFrame, classes: np.ndarray, k: int, t: Fraction) -> DataFrame:
    """(rid, n, tokens, bits) of the sets that can have a different partner; bits as from parity()."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)
    schema = "rid long, n int, tokens array<long>, bits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = shared.value
        for b in batches:
            for s in tk.slices(b.column(1)):
                rids, ns, lists, ends, bits = [], [], [], [0], []
                for i, x in enumerate(shingles(s, k)):
                    n = len(x)
                    if n * t.denominator < t.numerator * (n + 1):  # not even all of it and one more are enough
                        continue
                    head = x[np.argsort(cls[_slot(x, len(cls))], kind="stable")[: prefix_length(n, t)]]  # x is sorted: ties by hash
                    rids.append(b.column(0)[s.first + i].as_py())
                    ns.append(n)
                    lists.append(head)
                    ends.append(ends[-1] + len(head))
                    bits.append(parity(x))
                if rids:
                    flat = pa.array(np.concatenate(lists).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(ns, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(bits, pa.binary())], names=["rid", "n", "tokens", "bits"])

    return spread(rows.select("rid", "text")).mapInArrow(run, schema)


def parity(x: np.ndarray) -> bytes:
    """A bit per hash value modulo about twice the set's size: whether an odd number of shingles falls there.

    Each shingle that only one of two sets has flips one bit, so the bits that differ are a lower bound of the sets'
    symmetric difference. Parities of unequal length are compared after folding the longer one.
    """
    size = 1 << max(6, int(2 * len(x) - 1).bit_length())
    return np.packbits((np.bincount((x & tk.U(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """The number of bits in which two parities differ."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


BOUNDS = "leader long, node long, n_leader long, n long, overlap long"


def bounds(pairs: DataFrame) -> DataFrame:
    """An upper bound of the overlap of each pair; pairs: (leader, node, nl, n, bl, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nl, n = b.column(2).to_numpy(), b.column(3).to_numpy()
            most = [(x + y - apart(p, q)) // 2 for x, y, p, q in zip(nl.tolist(), n.tolist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            cols = [b.column(0), b.column(1), pa.array(nl, pa.int64()), pa.array(n, pa.int64()), pa.array(np.minimum(most, np.minimum(nl, n)) if most else [], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in BOUNDS.split(", ")])

    return pairs.select("leader", "node", "nl", "n", "bl", "b").mapInArrow(run, BOUNDS)


def _reaches(t: Fraction):
    """Whether an overlap (or its bound) is enough for similarity t."""
    return F.col("overlap") * t.denominator >= (F.col("n_leader") + F.col("n") - F.col("overlap")) * t.numerator


def packed(rows: DataFrame) -> DataFrame:
    """(rid, z): texts compressed, as they travel in shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.compress(x.encode()) for x in b.column(1).to_pylist()], pa.binary())], names=["rid", "z"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, z binary")


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    at = 0
    while at < len(texts):
        raw, size = [], 0
        while at < len(texts) and size < tk.SLICE_BYTES:
            raw.append(d.decompress(texts[at]))
            size += len(raw[-1])
            at += 1
        for s in tk.slices(pa.array(raw, pa.large_binary()).cast(pa.large_string())):
            yield from shingles(s, k)


DIFFERENCES = "leader long, node long, n_leader long, n long, overlap long, lacks binary, adds binary"


def differences(pairs: DataFrame, k: int) -> DataFrame:
    """Overlaps of (leader, node, zl, z), with the differences of sets that are at least half similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], {"long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in DIFFERENCES.split(", ")])
        last, lead = None, np.empty(0, np.uint64)
        for b in batches:
            out, size = [], 0
            leaders, nodes, zl = (b.column(i).to_pylist() for i in range(3))
            for leader, node, first, x in zip(leaders, nodes, zl, _sets(b.column(3).to_pylist(), k), strict=True):
                if leader != last:
                    last, (lead,) = leader, _sets([first], k)
                o = len(np.intersect1d(lead, x, assume_unique=True))
                row = {"leader": leader, "node": node, "n_leader": len(lead), "n": len(x), "overlap": o, "lacks": None, "adds": None}
                if o * HALF.denominator >= HALF.numerator * (len(lead) + len(x) - o):
                    row["lacks"] = np.setdiff1d(lead, x, assume_unique=True).tobytes()
                    row["adds"] = np.setdiff1d(x, lead, assume_unique=True).tobytes()
                    size += len(row["lacks"]) + len(row["adds"])
                out.append(row)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return pairs.select("leader", "node", "zl", "z").mapInArrow(run, DIFFERENCES)


def _common(raws: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of sets, each the bytes of its hashes, and those of their pairwise intersections."""
    raws = raws.cast(pa.large_binary())
    n = len(raws)
    out = np.zeros((n, n), np.float32)
    ends = np.frombuffer(raws.buffers()[1], np.int64)[raws.offset : raws.offset + n + 1] // 8
    sizes = np.diff(ends)
    flat = np.frombuffer(raws.buffers()[2], np.uint64)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint64)
    order = np.argsort(flat)
    s = flat[order]
    new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
    count = np.diff(new, append=len(s))
    col = np.repeat(np.cumsum(count > 1) - 1, count)  # a number for each hash that two sets have
    keep = np.repeat(count > 1, count)
    row, col = np.repeat(np.arange(n), sizes)[order[keep]], col[keep]
    # hashes of few sets give their pairs of rows, those of many a product of 0-1 matrices: whichever is less work
    few = count[count > 1] ** 2 <= 4 * n
    of_few = few[col] if len(col) else np.empty(0, bool)
    flat_pairs, size = [], 0
    for c in np.unique(count[count > 1][few]).tolist():
        block = row[of_few & (count[count > 1][col] == c)].reshape(-1, c) if len(col) else np.empty((0, c), np.int64)
        for lo in range(0, len(block), PAIRS // c**2 + 1):
            part = block[lo : lo + PAIRS // c**2 + 1]
            flat_pairs.append((part[:, :, None] * n + part[:, None, :]).ravel())
            size += len(flat_pairs[-1])
            if size > PAIRS:
                out += np.bincount(np.concatenate(flat_pairs), minlength=n * n).reshape(n, n)
                flat_pairs, size = [], 0
    if size:
        out += np.bincount(np.concatenate(flat_pairs), minlength=n * n).reshape(n, n)
    row, col = row[~of_few], col[~of_few]
    if len(col):
        col = np.cumsum(np.r_[0, col[1:] != col[:-1]])
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 2048):
        a, b = np.searchsorted(col, [lo, lo + 2048])
        m = np.zeros((n, 2048), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return sizes, out


def _cell(t: Fraction):
    """Links within one cell of a leader's members, as a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        table = table.combine_chunks()
        column = lambda c: table[c].to_numpy()
        node, n = column("node"), column("n")
        lead, n_lead = table["leader"][0].as_py(), table["n_leader"][0].as_py()
        (missing, lacks), (_, adds) = (_common(pa.concat_arrays(table[c].chunks)) for c in ("lacks", "adds"))
        o = np.rint(n_lead - missing[:, None] - missing[None, :] + lacks + adds).astype(np.int64)
        linked = o * t.denominator >= t.numerator * (n[:, None] + n[None, :] - o)
        own = column("overlap")
        near = own * t.denominator >= t.numerator * (n_lead + n - own)
        todo, out = ~near, []
        # the leader's own component first: whatever a linked set is linked to
        front = near.copy()
        while front.any():
            new = linked[front].any(0) & todo
            out += [(int(x), lead) for x in node[new]]
            todo &= ~new
            front = new
        while todo.any():
            first = int(np.flatnonzero(todo)[0])
            todo[first] = False
            front = np.zeros(len(node), bool)
            front[first] = True
            while front.any():
                new = linked[front].any(0) & todo
                out += [(int(x), int(node[first])) for x in node[new]]
                todo &= ~new
                front = new
        return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=schema)

    return run


def _links(found: DataFrame, t: Fraction) -> DataFrame:
    return found.where(_reaches(t)).select(F.col("leader").alias("a"), F.col("node").alias("b"))


def _derived(found: DataFrame, t: Fraction) -> DataFrame:
    """Links among the members of each leader, from their differences."""
    union = F.col("n_leader") + F.col("n") - F.col("overlap")
    ring = F.expr(f"((n_leader + n - 2 * overlap) * {t.denominator}) div ((n_leader + n - overlap) * {t.denominator - t.numerator})")
    kept = found.where(F.col("lacks").isNotNull() & (union > 0)).withColumn("ring", ring.cast("int"))
    size = F.octet_length("lacks") + F.octet_length("adds")
    parts = lambda c, b: F.ceil(F.greatest(c / CELL, b / CELL_BYTES)).cast("int")
    rings = kept.groupBy("leader", "ring").agg(F.count(F.lit(1)).alias("c"), F.sum(size).alias("b")).withColumn("parts", parts(F.col("c"), F.col("b")))
    around = rings.groupBy("leader").agg(F.max("ring").alias("outermost"), parts(F.sum("c"), F.sum("b")).alias("all"), F.map_from_entries(F.collect_list(F.struct("ring", "parts"))).alias("parts"))
    # a leader's few members are one cell; of many, a ring with the one outside it, and every ring but the innermost with itself
    few = F.col("all") == 1
    around = around.where("outermost > 0").select("leader", few.alias("few"), F.when(few, F.create_map(F.lit(1), F.lit(1))).otherwise(F.col("parts")).alias("parts"))
    cells = kept.hint("merge").join(around, "leader").withColumn("ring", F.when(F.col("few"), 1).otherwise(F.col("ring"))).withColumn("p", F.expr("pmod(xxhash64(node), parts[ring])"))
    outside = F.expr("transform(sequence(0, coalesce(parts[ring + 1], 0)), q -> struct(ring as inner, ring + 1 as outer, p as a, cast(q - 1 as bigint) as b))")
    inside = F.expr("transform(sequence(0, if(ring > 0, coalesce(parts[ring - 1], 0), 0)), q -> struct(ring - 1 as inner, ring as outer, cast(q - 1 as bigint) as a, p as b))")
    own = F.expr("transform(sequence(0, if(ring > 0, parts[ring], 0)), q -> struct(ring as inner, ring as outer, least(p, q - 1) as a, greatest(p, q - 1) as b))")
    cells = cells.select(*kept.columns, F.explode(F.concat(*(F.slice(c, 2, F.size(c)) for c in (outside, inside, own)))).alias("cell"))
    cells = cells.select("leader", "node", "n_leader", "n", "overlap", "lacks", "adds", F.col("cell.inner").alias("inner"), F.col("cell.outer").alias("outer"), F.col("cell.a").alias("i"), F.col("cell.b").alias("j"))
    return cells.groupBy("leader", "inner", "outer", "i", "j").applyInArrow(_cell(t), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 3, threshold: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rid, n_shingles, component_id and first_rid of every row of docs: documents linked at the threshold, directly or not.

    component_id is the smallest id of a component, and first_rid the number of the row that has it (the smallest, if several do).
    """
    t = threshold
    rows = with_rid(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(RID).alias("rid"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("ord"), whole_text(text_col).alias("text")
    )
    bits = sketch_bits(docs)
    scanned = materialize(scan(rows, k, bits), "sets")
    sets = scanned.where("kind = 0")
    nodes = materialize(sets.where("digest is not null").groupBy("digest").agg(F.min(F.struct("ord", "rid")).alias("m")).select("digest", F.col("m.rid").alias("node"), F.col("m.ord").alias("ord")), "nodes")
    heads = materialize(prefixes(rows, ranks(scanned, bits), k, t).join(nodes.select(F.col("node").alias("rid")), "rid"), "prefixes")
    lists = heads.select(F.col("rid").alias("node"), "n", F.posexplode("tokens").alias("pos", "token"))
    # tables, not aggregates, are what the joins by token read, so that a hot token's rows can be split there
    met = materialize(lists.select("token").groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token"), "met")
    band = F.floor(F.log(F.col("n")) / F.lit(log(1 / t) * 1.0001)).cast("int")
    entries = materialize(lists.join(met, "token").withColumn("band", F.explode(F.array(band, band + 1))), "entries")
    reach = (t.denominator - t.numerator, t.denominator + t.numerator)  # i + j <= (|x| + |y|) (1 - t) / (1 + t)
    blocks = entries.groupBy("token", "band").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("leader"), F.min("pos").alias("near"), F.max("n").alias("most"))
    blocks = blocks.where((F.col("c") > 1) & (F.col("near") * reach[1] <= F.col("most") * reach[0]))
    blocks = materialize(blocks.select("token", "band", "leader"), "blocks")
    live = entries.join(blocks, ["token", "band"])
    stars = live.where("node <> leader").select("leader", "node").distinct()
    # bits and texts are joined in one way whatever the sizes, so that what they need grows with the input
    own_bits = heads.select(F.col("rid").alias("node"), "n", F.col("bits").alias("b"))

    def bounded(pairs: DataFrame) -> DataFrame:
        one = own_bits.hint("merge").join(pairs, "node")
        return bounds(one.hint("merge").join(own_bits.select(F.col("node").alias("leader"), F.col("n").alias("nl"), F.col("b").alias("bl")), "leader"))

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs whose bound is enough, by their texts."""
        ids = materialize(pairs.select(F.col("leader").alias("rid")).union(pairs.select(F.col("node").alias("rid"))).distinct(), "ids")
        texts = materialize(packed(may_be_in(rows, ids)).hint("merge").join(ids, "rid"), "texts")
        one = texts.select(F.col("rid").alias("node"), "z").hint("merge").join(pairs.select("leader", "node"), "node")
        two = one.hint("merge").join(texts.select(F.col("rid").alias("leader"), F.col("z").alias("zl")), "leader").sortWithinPartitions("leader")
        return materialize(differences(two, k), "differences")

    stars = materialize(bounded(stars), "stars")
    none = F.lit(None).cast("binary")
    found = verified(stars.where(_reaches(HALF))).unionByName(stars.where(~_reaches(HALF)).withColumn("lacks", none).withColumn("adds", none))
    # sets far from a leader can only be linked to sets that are not close to it either
    far_reach = float(HALF) + (1 - float(t))
    sim = F.col("overlap") / (F.col("n_leader") + F.col("n") - F.col("overlap"))
    away = found.where(sim <= far_reach + 1e-9).select("leader", "node", F.col("lacks").isNull().alias("far"))
    rest = live.where("node <> leader").join(away, ["leader", "node"]).select("token", "band", "node", "n", "pos", "far")
    other = rest.select("token", "band", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "pos", "far")))
    close = (F.least("n", "n2") * t.denominator >= F.greatest("n", "n2") * t.numerator) & ((F.col("pos") + F.col("pos2")) * reach[1] <= (F.col("n") + F.col("n2")) * reach[0])
    direct = rest.join(other, ["token", "band"]).where((F.col("node") < F.col("node2")) & (F.col("far") | F.col("far2")) & close)
    pairs = materialize(bounded(direct.select(F.col("node").alias("leader"), F.col("node2").alias("node")).distinct()).where(_reaches(t)), "pairs")
    edges = union_all([_links(found, t), _derived(found, t), _links(verified(pairs), t)])
    labels = components(edges)
    least = labels.join(nodes, "node").groupBy("label").agg(F.min(F.struct("ord", "node")).alias("first"))
    # a set without links is its own label, so that no key stands for all of them
    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = labelled.hint("merge").join(least, "label", "left").select("digest", F.coalesce("first", F.struct("ord", "node")).alias("first"))
    first = F.coalesce("first", F.struct(F.col("ord"), F.col("rid").alias("node")))
    own = sets.join(named, "digest", "left").select("doc_id", "rid", "n", first.alias("first"))
    return own.select("doc_id", "rid", F.col("n").alias("n_shingles"), F.when(F.col("first.ord") != _NULL_ID, F.col("first.ord")).alias("component_id"), F.col("first.node").alias("first_rid"))


def keep_first(docs: DataFrame, k: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """docs with one document of each component, the one with the smallest id; columns as they were.

    Of rows that repeat that id one stays, if their component is the same.
    """
    rows = with_rid(docs)
    return without(rows, jaccard_components(rows, k, threshold).where("rid <> first_rid")).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).drop("rid", "first_rid")


#: Pairs by shared shingles; a link's other end has a size within the threshold. Components by a recursive walk.
SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
        else list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) end as sh from w),
n as (select doc_id, len(sh) as n_shingles from s),
e as (select doc_id, hash(g) as g from (select doc_id, unnest(sh) as g from s)),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 90 * (x.n_shingles + y.n_shingles - o)),
r as (select doc_id as node, doc_id as root from n union select l.b, r.root from r join l on l.a = r.node)
select n.doc_id, n.n_shingles, min(r.root) as component_id from n join r on r.node = n.doc_id group by all
"""
