"""WARC archives with a Zstandard dictionary, written and read back by executors.

A partition of pages becomes one or more ``.warc.zst`` archives. The first records of an archive (at most
``SAMPLE_BYTES``) train its dictionary; the archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself compressed, and every record is a frame of its own, so any record can be read alone. Of equal
payloads one page has the response record, and the others are revisit records that refer to it: the page with the
largest id. Payloads meet by SHA-256, reduced map side first, so a payload that a third of all pages share
is one row before the shuffle. Payloads themselves stay where they are read: a revisit record needs its payload's length and digest only,
and of the pages that a bitmap of the revisits can't rule out, few but revisits, those that are responses after all are found by a join.

Archives go through pyarrow's file systems (file, s3, gs, hdfs, ...) to the shared folder. Their names carry the task's attempt, and the
manifest, which Spark commits once a task, names those of the attempt that counts; what other attempts left is deleted.

Defined results: a null payload counts as empty; a null id is smaller than any id and comes back as null; of rows that
repeat an id and a payload one is the response; a null address is written as ``urn:none``; too few records to train
on give an archive without dictionary; a payload of any length is one record; an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RID, delete, is_not_in, list_names, materialize, may_be_in, scratch, union_all, whole_text, with_rid

DICTIONARY_FRAME = 0x184D2A5D
#: Raw bytes of an archive, of a dictionary, and of the records that it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 256 << 20, 64 << 10, 4 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, raw_bytes long, bytes long, dictionary_bytes long"
RECORD = "page_id long, rid long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None, rid: int) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{rid}>"


def record(page: int | None, rid: int, url: str | None, payload: bytes | None, length: int, sha1: bytes, refers: tuple[int | None, int] | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC 1.1 record: a response, or a revisit (refers) whose block has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_urn(page, rid)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=chr(37) + ':/?#[]@!$&()*+,;=~') if url else 'urn:none'}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
    ]
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(*refers)}"]
    body = b"" if refers else payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return b"".join(("\r\n".join(head).encode(), b"\r\n\r\n", http, body, b"\r\n\r\n"))


def parse(raw: bytes) -> dict:
    """The fields of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    ids = lambda u: [int(x) if x else None for x in u.strip("<>").split(":")[2:]]
    page, rid = ids(h["WARC-Record-ID"])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
    refers = ids(h["WARC-Refers-To"])[0] if "WARC-Refers-To" in h else None
    return {"page_id": page, "rid": rid, "url": h["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": refers, "payload": payload}


def train(records: list[bytes]):
    """A dictionary from archived records, or None where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records)
    except zstandard.ZstdError:
        return None


def write_archive(out: io.RawIOBase, records: Iterator[bytes], limit: int = ARCHIVE_BYTES) -> tuple[int, int, int, int]:
    """Write records until the limit; returns (records, raw bytes, bytes, dictionary bytes)."""
    import zstandard

    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    d = train(first)
    written = 0
    if d is not None:
        frame = zstandard.ZstdCompressor(level=19).compress(d.as_bytes())
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(frame)) + frame)
        written += 8 + len(frame)
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True)
    n = raw = 0

    def put(r: bytes) -> int:
        z = c.compress(r)
        out.write(z)
        return len(z)

    for r in first:
        written, n, raw = written + put(r), n + 1, raw + len(r)
    del first
    if raw < limit:
        for r in records:
            written, n, raw = written + put(r), n + 1, raw + len(r)
            if raw >= limit:
                break
    return n, raw, written, 0 if d is None else len(d.as_bytes())


def read_archive(source: io.RawIOBase, chunk: int = 64 << 10) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    import zstandard

    head = source.read(8)
    d = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_FRAME:
        d = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(source.read(struct.unpack("<II", head)[1])))
        head = b""
    z = zstandard.ZstdDecompressor(dict_data=d) if d is not None else zstandard.ZstdDecompressor()
    rest = head
    while True:
        rest = rest or source.read(chunk)
        if not rest:
            return
        one, parts = z.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            rest = source.read(chunk)
            if not rest:
                raise EOFError("the archive ends within a record")
        yield b"".join(parts)


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


ROWS = "page_id long, rid long, url string, n long, sha1 binary, payload binary, squeezed boolean, to_page long, to_rid long"


def _squeezed(rows: DataFrame) -> DataFrame:
    """Payloads compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        at = [x.split()[0] for x in ROWS.split(", ")].index("payload")
        for b in batches:
            z = pa.array([c.compress(x) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([z if i == at else x for i, x in enumerate(b.columns)], schema=b.schema)

    return rows.withColumn("squeezed", F.lit(True)).mapInArrow(run, ROWS)


def archive(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write pages to archives below folder; returns the manifest. Equal payloads under min_bytes are all responses."""
    from pyspark import TaskContext

    spark, payload = pages.sparkSession, whole_text(payload_col)
    src = with_rid(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(RID).alias("rid"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    n, sha1 = F.octet_length("payload").cast("long"), F.unhex(F.sha1("payload"))
    keys = materialize(src.select("page_id", "rid", "url", n.alias("n"), sha1.alias("sha1"), F.unhex(F.sha2("payload", 256)).alias("sha256")), "payloads").where(F.col("n") >= min_bytes)
    best = keys.groupBy("sha256").agg(F.max(F.struct("page_id", "rid")).alias("best"), F.count(F.lit(1)).alias("c")).where("c > 1")
    best = materialize(best.select("sha256", "best"), "best")  # a table, so that the join can split a hot payload
    revisits = keys.join(best, "sha256").where(F.col("rid") != F.col("best.rid")).select("page_id", "rid", "url", "n", "sha1", F.lit(None).cast("binary").alias("payload"), F.lit(False).alias("squeezed"), F.col("best.page_id").alias("to_page"), F.col("best.rid").alias("to_rid"))
    revisits = materialize(revisits, "revisits")
    none = F.lit(None).cast("long")
    whole = lambda rows: rows.select("page_id", "rid", "url", n.alias("n"), sha1.alias("sha1"), F.encode("payload", "UTF-8").alias("payload"), F.lit(False).alias("squeezed"), none.alias("to_page"), none.alias("to_rid"))
    maybe, again = _squeezed(whole(may_be_in(src, revisits))), revisits.select(F.col("rid").alias("r"), F.col("page_id").alias("p"))
    others = maybe.join(again, (maybe["rid"] == again["r"]) & maybe["page_id"].eqNullSafe(again["p"]), "left_anti")
    planned = union_all([whole(is_not_in(src, revisits)), others, revisits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()

        def records() -> Iterator[bytes]:
            import zstandard

            z = zstandard.ZstdDecompressor()
            for b in batches:
                for page, rid, url, n, sha1, payload, squeezed, to_page, to_rid in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    yield record(page, rid, url, z.decompress(payload) if squeezed else payload, n, sha1, None if to_rid is None else (to_page, to_rid))

        it, k = records(), 0
        files, base = _fs(folder)
        files.create_dir(base, recursive=True)
        for head in it:
            name = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{k:04d}.warc.zst"

            def rest(head: bytes = head) -> Iterator[bytes]:
                yield head
                yield from it

            with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                n, raw, size, d = write_archive(out, rest())
            k += 1
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n, "raw_bytes": raw, "bytes": size, "dictionary_bytes": d}])

    manifest = materialize(planned.mapInArrow(run, MANIFEST), "manifest")
    counted = {r["path"].rsplit("/", 1)[1] for r in manifest.select("path").collect()}  # a name an archive
    for name in list_names(spark, folder):
        if name.startswith("part-") and name not in counted:
            delete(spark, f"{folder}/{name}")
    return manifest


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that a manifest lists, digests verified."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                files, at = _fs(path)
                rows, size = [], 0
                with files.open_input_stream(at, compression=None) as f:
                    for raw in read_archive(f):
                        row = parse(raw)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += len(raw) if payloads else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(n, "path").mapInArrow(run, RECORD).select(*names)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = archive(pages, scratch(spark, "warc"))
    return read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 from the hexadecimal digest: each five digits are four characters.
SQL = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
m as (select page_id, h, x, max(page_id) over (partition by h) as top from p)
select page_id, octet_length(encode(h)) as payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(x, 1 + 5 * (k // 4)::int, 5))::int >> (15 - 5 * (k % 4)::int)) & 31) + 1, 1)), lambda a, b: a || b) as payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id = top then null else top end as refers_to
from m
"""
