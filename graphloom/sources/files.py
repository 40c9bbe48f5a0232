"""Listing source files and reading their bytes.

Spark's file sources leave out names that begin with an underscore, so the listing is made on the driver and the
bytes are read on executors: from a folder that all of them see, or from a store by its URI through pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.base import LANGUAGES
from ..functions.text import extension
from ..schema import FILES

#: Names that are never listed.
IGNORED = ("node_modules", ".git", ".pi", "dist", "build", ".next", ".cache", "__pycache__", "coverage", ".nyc_output", "graph-out", ".graphify")
MAX_FILES, MAX_BYTES, STALE_FILES = 10_000, 1_000_000, 200


def wanted_path(path: Column) -> Column:
    """Whether no segment of a relative path is ignored or begins with a dot, and the extension is a known one."""
    segments = F.split(path, "/")
    hidden = F.exists(segments, lambda s: s.startswith(".") | s.isin(*IGNORED))
    return ~hidden & extension(path).isin(*LANGUAGES)


def _walk(root: str) -> Iterator[tuple[str, os.stat_result]]:
    """Symlinked folders are followed once each; what can't be read is skipped."""
    seen: set[tuple[int, int]] = set()

    def visit(folder: str) -> Iterator[tuple[str, os.stat_result]]:
        try:
            names = sorted(os.listdir(folder))
        except OSError:
            return
        for name in names:
            if name in IGNORED or name.startswith("."):
                continue
            full = os.path.join(folder, name)
            try:
                st = os.stat(full)
            except OSError:
                continue
            if os.path.isdir(full):
                if (st.st_dev, st.st_ino) not in seen:
                    seen.add((st.st_dev, st.st_ino))
                    yield from visit(full)
            elif os.path.isfile(full):
                yield full, st

    yield from visit(root)


def _is_uri(root: str) -> bool:
    return "://" in root


def _listed(root: str) -> Iterator[tuple[str, int, float]]:
    """(path below root, size, seconds of last change) of all files that are not ignored: a local folder, or a store by its URI."""
    if _is_uri(root):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        if store.get_file_info(base).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"Path does not exist: {root}")
        for x in store.get_file_info(fs.FileSelector(base, recursive=True)):
            path = x.path[len(base.rstrip("/")) + 1 :]
            if x.is_file and not any(p in IGNORED or p.startswith(".") for p in path.split("/")):
                yield path, x.size, (x.mtime_ns or 0) / 1e9
        return
    root = os.path.abspath(root)
    if not os.path.exists(root):
        raise FileNotFoundError(f"Path does not exist: {root}")
    for full, st in _walk(root):
        yield os.path.relpath(full, root).replace(os.sep, "/"), st.st_size, st.st_mtime


def _reader(root: str):
    """A function from a path below root to its bytes, for use on executors."""
    if not _is_uri(root):
        root = os.path.abspath(root)

        def local(path: str) -> bytes:
            with open(os.path.join(root, path), "rb") as f:
                return f.read()

        return local

    def remote(path: str) -> bytes:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        with store.open_input_stream(f"{base.rstrip('/')}/{path}", compression=None) as f:
            return f.read()

    return remote


def list_files(spark: SparkSession, root: str, max_files: int | None = MAX_FILES) -> DataFrame:
    """files: the first max_files code files below root by path, or all (the cap counts after sorting, so it is deterministic)."""
    rows = []
    for path, size, mtime in _listed(root):
        name = path.rsplit("/", 1)[-1]
        ext = name[name.rindex(".") :] if "." in name else ""
        if ext in LANGUAGES:
            rows.append((path, ext, LANGUAGES[ext], size, mtime * 1000))
    rows.sort(key=lambda r: r[0].encode("utf-16-be"))
    return spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows[:max_files])], FILES)


def all_paths(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root (path), detected or not: what imports may refer to."""
    return spark.createDataFrame([(path,) for path, _, _ in _listed(root)], "path string")


def by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("n"))


def content_hash(content: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def read_contents(files: DataFrame, root: str, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """files with hash and content; content is null for files that are too large (None: no limit) or can't be read."""
    read = _reader(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes, contents = [], []
            for path in pdf["path"]:
                try:
                    raw = read(path)
                except OSError:
                    raw = None
                hashes.append(None if raw is None else hashlib.sha256(raw).hexdigest()[:16])
                contents.append(None if raw is None or (max_bytes is not None and len(raw) > max_bytes) else raw.decode("utf-8", "replace"))
            yield pdf.assign(hash=hashes, content=contents)[[*FILES.names, "content"]]

    parts = max(1, min(files.sparkSession.sparkContext.defaultParallelism * 4, files.count() // 16 + 1))
    return files.repartition(parts, "path").mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FILES) + ", content string")


def staleness(files: DataFrame, graph_mtime: float, first: int = STALE_FILES) -> DataFrame:
    """One row (stale, count): how many of the first files by order are newer than the graph."""
    head = files.orderBy("ord").limit(first)
    return head.agg(F.count(F.when(F.col("mtime") > graph_mtime, 1)).alias("count")).select((F.col("count") > 0).alias("stale"), "count")
