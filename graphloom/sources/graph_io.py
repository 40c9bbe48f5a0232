"""Graphs and the extraction cache on disk: Parquet tables, and one JSON document for exchange."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CACHE, EDGES, NODES

_JSON_NODE = {"id": "id", "label": "label", "type": "type", "source_file": "sourceFile", "source_location": "sourceLocation", "description": "description", "community": "community", "centrality": "centrality"}
_JSON_EDGE = {"source": "source", "target": "target", "relation": "relation", "confidence": "confidence", "confidence_score": "confidenceScore"}


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two Parquet tables below path, written beside the old ones' readers: a new version each time, then a pointer."""
    spark = nodes.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(conf)
    fs.mkdirs(base)
    old = [x.getPath().getName() for x in fs.listStatus(base) if x.getPath().getName().startswith("v")]
    version = f"v{1 + max([int(x[1:]) for x in old], default=0):06d}"
    nodes.write.parquet(f"{path}/{version}/nodes")
    edges.write.parquet(f"{path}/{version}/edges")
    fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{version}/_READY"), True).close()
    for x in sorted(old)[:-1]:  # the previous version stays for readers that began with it
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{x}"), True)


def _latest(spark: SparkSession, path: str) -> str | None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(conf)
    if not fs.exists(base):
        return None
    ready = [x.getPath().toString() for x in fs.listStatus(base) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath().toString() + "/_READY"))]
    return max(ready, default=None)


def graph_exists(spark: SparkSession, path: str) -> bool:
    return _latest(spark, path) is not None


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    at = _latest(spark, path)
    if at is None:
        raise FileNotFoundError(f"no graph in {path}")
    return spark.read.schema(NODES).parquet(f"{at}/nodes"), spark.read.schema(EDGES).parquet(f"{at}/edges")


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One pretty JSON document {nodes, edges}, streamed through the driver; absent values are left out."""

    def items(df: DataFrame, names: dict[str, str]):
        for r in df.orderBy("ord").toLocalIterator():
            yield {k: r[c] for c, k in names.items() if r[c] is not None}

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("{\n")
        for key, df, names, end in (("nodes", nodes, _JSON_NODE, ",\n"), ("edges", edges, _JSON_EDGE, "\n")):
            f.write(f'  "{key}": [')
            for k, item in enumerate(items(df, names)):
                f.write(",\n" if k else "\n")
                f.write("\n".join("    " + line for line in json.dumps(item, indent=2, ensure_ascii=False).split("\n")))
            f.write(f"\n  ]{end}")
        f.write("}\n")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables of a JSON graph; positions become ord. Dangling edges are left to build()."""
    node = "struct<" + ",".join(f"{k}:{NODES[c].dataType.simpleString()}" for c, k in _JSON_NODE.items()) + ">"
    edge = "struct<" + ",".join(f"{k}:{EDGES[c].dataType.simpleString()}" for c, k in _JSON_EDGE.items()) + ">"
    raw = spark.read.schema(f"nodes array<{node}>, edges array<{edge}>").json(path, multiLine=True)
    nodes = raw.select(F.posexplode("nodes").alias("ord", "x")).select(F.col("ord").cast("long"), *(F.col(f"x.{k}").alias(c) for c, k in _JSON_NODE.items()))
    edges = raw.select(F.posexplode("edges").alias("ord", "x")).select(F.col("ord").cast("long"), *(F.col(f"x.{k}").alias(c) for c, k in _JSON_EDGE.items()))
    return nodes.select(*NODES.names), edges.select(*EDGES.names)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Absent or unreadable: empty. Where a write was cut short, the cache before it."""
    for at in (path, f"{path}.old"):
        try:
            out = spark.read.schema(CACHE).parquet(at)
            out.limit(1).collect()
            return out
        except Exception as e:  # noqa: BLE001  whatever a broken cache raises, it is rebuilt
            if not (isinstance(e, AnalysisException) or "Parquet" in str(e) or "FileNotFound" in str(e) or "parquet" in str(e)):
                raise
    return spark.createDataFrame([], CACHE)


def write_cache(cache: DataFrame, path: str) -> None:
    """Beside the old one, which the new cache is computed from, then in its place; one of the two is whole at any time."""
    spark = cache.sparkSession
    cache.write.mode("overwrite").parquet(f"{path}.new")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, to = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}.new", f"{path}.old", path))
    fs = to.getFileSystem(conf)
    if fs.exists(to):
        fs.delete(old, True)
        if not fs.rename(to, old):
            raise OSError(f"can't move the cache {path}")
    if not fs.rename(new, to):
        raise OSError(f"can't write the cache {path}")
    fs.delete(old, True)
