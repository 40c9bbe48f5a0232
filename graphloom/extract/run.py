"""Extraction as a table function: files to nodes and edges, with a cache by content hash."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import first_wins
from ..schema import CACHE
from ..sources.files import MAX_BYTES, MAX_FILES, all_paths, list_files, read_contents
from ..sources.graph_io import read_cache, write_cache
from .base import LANGUAGES, Facts
from .others import FAMILIES, extract_generic, extract_go, extract_json, extract_shell
from .python import extract_python
from .script import extract_script, named_imports

#: Suffixes tried, in order, for a relative import.
SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".mts", ".cjs", ".cts")


def candidates(importer: str, target: str, normalise: bool = False) -> list[str]:
    """The paths that a relative import may mean, best first.

    Without normalise, a path with ``..`` keeps it and so names no known file, as in the compared behaviour.
    """
    folder = posixpath.dirname(importer)
    path = posixpath.join(folder, target)
    if normalise or ".." not in path.split("/"):
        path = posixpath.normpath(path)
    else:
        path = "/".join(x for x in path.split("/") if x != ".")
    ext = posixpath.splitext(path)[1]
    exact = [path] if ext in LANGUAGES else []
    return [*exact, *(path + s for s in SUFFIXES), *(f"{path}/index{s}" for s in SUFFIXES)]


def extract_source(path: str, content: str, exists: set[str] | None = None, complete: bool = False, resolved: Callable[[str], str | None] | None = None) -> Facts:
    """The facts of one file; complete adds what the compared behaviour leaves out.

    Relative imports are resolved among exists (None: any path does), or by resolved where it is given.
    """

    def resolve(importer: str, target: str) -> str | None:
        if resolved:
            return resolved(target)
        return next((c for c in candidates(importer, target, complete) if exists is None or c in exists), None)

    language = LANGUAGES.get("." + path.rsplit(".", 1)[-1] if "." in path else "")
    if language in ("javascript", "typescript"):
        facts = extract_script(path, content, resolve, language == "typescript")
        if complete:
            facts.edges += named_imports(path, content, resolve)
        return facts
    if language == "python":
        return extract_python(path, content, methods=complete)
    if language == "go":
        return extract_go(path, content)
    if language == "bash":
        return extract_shell(path, content)
    if language == "json":
        return extract_json(path, content)
    if language in FAMILIES:
        return extract_generic(path, content, language, complete)
    raise ValueError(f"no extractor for {path}")


#: Extracted rows that a worker holds before it passes them on, besides one file's.
RAW_ROWS = 5000
RAW = "file string, hash string, file_ord int, kind string, local_ord int, id string, label string, type string, location string, description string, source string, target string, relation string, confidence string, score double"


def _imports(contents: DataFrame, complete: bool) -> DataFrame:
    """(path, key, candidates) of the relative imports of script files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                asked: dict[str, None] = {}
                with suppress(ValueError, RecursionError):
                    extract_source(path, content, None, complete, lambda target, asked=asked: asked.setdefault(target))
                rows += [(path, t, candidates(path, t, complete)) for t in asked]
            yield pd.DataFrame(rows, columns=["path", "key", "candidates"])

    scripts = [e for e, language in LANGUAGES.items() if language in ("javascript", "typescript")]
    return contents.where(F.col("content").isNotNull() & F.col("ext").isin(scripts)).select("path", "content").mapInPandas(run, "path string, key string, candidates array<string>")


def extract_table(contents: DataFrame, paths: set[str] | DataFrame | None = None, complete: bool = False) -> DataFrame:
    """Tagged rows, kind node or edge. contents: as from read_contents(); unknown or unread files give nothing.

    paths: what imports may refer to. A table (path) is joined with the imports' candidates, however long it is.
    """
    known = paths if isinstance(paths, set) else None
    if isinstance(paths, DataFrame):
        links = _imports(contents, complete).withColumn("key", F.struct("path", "key")).select("key", "candidates")
        found = resolve_links(links, paths).select(F.col("key.path").alias("path"), F.struct(F.col("key.key").alias("t"), F.col("path").alias("f")).alias("x"))
        found = found.groupBy("path").agg(F.collect_list("x").alias("x")).select("path", F.col("x.t").alias("targets"), F.col("x.f").alias("found"))  # a file's imports
        contents = contents.join(found, "path", "left")
    else:
        contents = contents.withColumn("targets", F.lit(None).cast("array<string>")).withColumn("found", F.lit(None).cast("array<string>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for o, path, h, content, targets, found in zip(pdf["ord"], pdf["path"], pdf["hash"], pdf["content"], pdf["targets"], pdf["found"], strict=True):
                if content is None or pd.isna(content):
                    continue
                own = {} if targets is None else dict(zip(targets, found, strict=True))
                try:
                    f = extract_source(path, content, known, complete, own.get if joined else None)
                except (ValueError, RecursionError):
                    continue
                rows += [(path, h, o, "node", k, *n, None, None, None, None, None) for k, n in enumerate(f.nodes)]
                rows += [(path, h, o, "edge", k, None, None, None, None, None, *e) for k, e in enumerate(f.edges)]
                if len(rows) >= most:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    most, columns = RAW_ROWS, [c.split()[0] for c in RAW.split(", ")]
    joined = isinstance(paths, DataFrame)
    return contents.select("ord", "path", "hash", "content", "targets", "found").mapInPandas(run, RAW)


def _grouped(raw: DataFrame) -> DataFrame:
    """One cache row per file; a file's facts are bounded by its size."""
    node = F.struct("local_ord", "id", "label", "type", F.col("location").alias("source_location"), "description")
    edge = F.struct("local_ord", "source", "target", "relation", "confidence", F.col("score").alias("confidence_score"))
    sides = raw.groupBy("file", "hash").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "node", node))).alias("nodes"), F.array_sort(F.collect_list(F.when(F.col("kind") == "edge", edge))).alias("edges"))
    return sides.select(*CACHE.names)


def resolve_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Ranked candidates against a listing: links (key, candidates array), targets (path); the best that exists.

    This is the join form of module resolution, for listings of any length.
    """
    tried = links.select("key", F.posexplode("candidates").alias("rank", "path"))
    return tried.join(targets, "path").groupBy("key").agg(F.min_by("path", "rank").alias("path"))


def extract_project(spark: SparkSession, root: str, cache_path: str | None = None, force: bool = False, complete: bool = False, max_files: int | None = MAX_FILES, max_bytes: int | None = MAX_BYTES) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """(files, nodes, edges, counts) of a source tree; unchanged files come from the cache. Limits of None are none."""
    files = list_files(spark, root, max_files)
    contents = read_contents(files, root, max_bytes)
    cache = read_cache(spark, cache_path) if cache_path and not force else spark.createDataFrame([], CACHE)
    keys = cache.select(F.col("file").alias("path"), "hash")
    fresh = contents.join(keys, ["path", "hash"], "left_anti").select(*contents.columns)
    reused = cache.join(contents.select(F.col("path").alias("file"), "hash"), ["file", "hash"], "left_semi")
    facts = reused.select(*CACHE.names).unionByName(_grouped(extract_table(fresh, all_paths(spark, root), complete))).persist()
    n_cached = reused.count()
    known = facts.join(files.select(F.col("path").alias("file"), F.col("ord").alias("file_ord")), "file")
    n = known.select("file", "file_ord", F.explode("nodes").alias("x")).select("file", "file_ord", "x.*")
    nodes = first_wins(n, ["id"], ["file_ord", "local_ord"]).select(
        (F.col("file_ord").cast("long") * 1_000_000 + F.col("local_ord")).alias("ord"), "id", "label", "type", F.col("file").alias("source_file"), "source_location", "description",
        F.lit(None).cast("int").alias("community"), F.lit(None).cast("double").alias("centrality"),
    )
    e = known.select("file_ord", F.explode("edges").alias("x")).select("file_ord", "x.*")
    edges = e.select((F.col("file_ord").cast("long") * 1_000_000 + F.col("local_ord")).alias("ord"), "source", "target", "relation", "confidence", "confidence_score")
    total = facts.count()
    if cache_path:
        gone = cache.join(facts.select("file"), "file", "left_anti")  # entries of deleted files stay
        write_cache(facts.unionByName(gone), cache_path)
    return files, nodes, edges, {"cached": n_cached, "extracted": total - n_cached}
