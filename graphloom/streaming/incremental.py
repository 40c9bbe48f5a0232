"""Structured Streaming upsert: node and edge rows that land as Parquet are merged into a stored graph.

The compared engine has no streaming; its incremental rebuild by content hash and its merge are what this expresses over
a stream. With dedup_edges a micro-batch that runs again after a failure changes nothing: its nodes are known and its
edges are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.build import build, merge
from ..schema import EDGES, NODES
from ..sources.graph_io import graph_exists, read_graph, write_graph

#: One stream carries both tables: kind is node or edge, the other's columns are null.
LANDING = ", ".join(["kind string", *(f"{f.name} {f.dataType.simpleString()}" for f in NODES), *(f"{f.name} {f.dataType.simpleString()}" for f in EDGES if f.name != "ord")])


def landing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge tables as rows of the landing schema."""
    return nodes.selectExpr("'node' as kind", "*").unionByName(edges.selectExpr("'edge' as kind", "*"), allowMissingColumns=True)


def upsert_stream(spark: SparkSession, folder: str, graph: str, checkpoint: str, dedup_edges: bool = True) -> StreamingQuery:
    """Merge all that has landed in folder so far; run again later for what lands meanwhile."""

    def one(batch: DataFrame, number: int) -> None:
        nodes, edges = batch.where("kind = 'node'").select(*NODES.names), batch.where("kind = 'edge'").select(*EDGES.names)
        if graph_exists(spark, graph):
            nodes, edges = merge(*read_graph(spark, graph), nodes, edges, dedup_edges)
        else:
            nodes, edges = build(nodes, edges)
        write_graph(nodes, edges, graph)

    stream = spark.readStream.schema(LANDING).parquet(folder)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
