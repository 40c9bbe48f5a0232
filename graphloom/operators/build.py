"""Building and merging graphs: nodes by id, edges with both ends, adjacency, set operations with order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each combination of keys; Spark prunes map side before it shuffles (group limit)."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", number).where(F.col("_rn") <= n).drop("_rn")


#: Bytes of input to a shuffle partition where Spark's own number would make larger ones. Tables are compressed and rows in memory are not.
PARTITION_BYTES, MOST_PARTITIONS = 4 << 20, 8192
#: Bytes of input up to which Spark may gather rows where they are read and merge its partitions.
LEFT_BYTES = 64 << 20


def input_bytes(*frames: DataFrame) -> int:
    """The size of what is read, as far as it is known."""
    known = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
        known += sum(x for x in sizes if x < 1 << 60)  # else unknown
    return known


def partitions_for(*frames: DataFrame) -> int:
    """Shuffle partitions by the size of what is read, so that a task's share doesn't grow with it; never fewer than the session's."""
    own = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, min(MOST_PARTITIONS, -(-input_bytes(*frames) // PARTITION_BYTES)))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many partitions as their input needs; small tables are left to the next operator.

    A larger table is dealt even if the session's number would do: else its rows are gathered where they are read, and adaptive execution merges the partitions.
    """
    n = partitions_for(df)
    small = input_bytes(df) <= LEFT_BYTES and n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if small else df.repartition(n, *keys)


#: Estimated bytes up to which the side of a join may be broadcast. Estimates are of compressed files: ten times the ids are in memory.
SMALL_BYTES = 256 << 10


def is_small(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES


def hashed(df: DataFrame) -> DataFrame:
    """The side of a join with one row a node: held by key in each task, so that the links it meets need no sort. A small one is left to Spark, to be broadcast."""
    return df if is_small(df) else df.hint("shuffle_hash")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _by(df, keys, [F.col(c).asc() for c in order])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _by(df, keys, [F.col(c).desc() for c in order])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return _by(df, keys, order, n)


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id")
    if not is_small(ids):  # a few chosen ones aren't dealt, whatever they were chosen from
        ids = hashed(dealt(ids, "id"))
    return edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, edges["target"] == ids["id"], "left_semi")


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges within a set of nodes (id)."""
    return drop_dangling(edges, chosen)


def build(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes with one id the last wins (at the first one's place); dangling edges go, parallel edges stay."""
    place = nodes.groupBy("id").agg(F.min("ord").alias("_first"))
    kept = last_wins(nodes, ["id"], ["ord"]).join(place, "id").withColumn("ord", F.col("_first")).select(*nodes.columns)
    return kept, drop_dangling(edges, kept)


def merge(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame, dedup_edges: bool = False) -> tuple[DataFrame, DataFrame]:
    """Add unseen nodes (existing ones are neither updated nor removed) and append all edges with both ends.

    ord of what is added continues after what is there. dedup_edges leaves out edges that are there already, which
    a repeated update of unchanged input would double.
    """
    top_n, top_e = nodes.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_top")), edges.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_top"))
    fresh = first_wins(more_nodes.join(hashed(dealt(nodes.select("id"), "id")), "id", "left_anti"), ["id"], ["ord"])
    fresh = fresh.join(F.broadcast(top_n)).withColumn("ord", F.col("ord") + F.col("_top") + 1).select(*nodes.columns)
    all_nodes = nodes.unionByName(fresh)
    added = drop_dangling(more_edges, all_nodes)
    if dedup_edges:
        there = ["source", "target", "relation"]
        added = added.join(hashed(dealt(edges.select(*there), *there)), there, "left_anti")
    added = added.join(F.broadcast(top_e)).withColumn("ord", F.col("ord") + F.col("_top") + 1).select(*edges.columns)
    return all_nodes, edges.unionByName(added)


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct symmetric neighbour pairs; nbr_ord is the order in which neighbours were first met.

    An unordered pair is one row until both its directions are known. The ends may be ids or numbers.
    """
    source, target, there = F.col("source"), F.col("target"), F.col("ord") * 2
    ahead = F.coalesce(source <= target, source.isNull())  # a null end counts as the least
    side = lambda x, y, name: F.when(ahead, x).otherwise(y).alias(name)
    pairs = edges.select(side(source, target, "a"), side(target, source, "b"), side(there, there + 1, "ab"))
    back = F.col("ab").bitwiseXOR(F.lit(1))  # 2 ord and 2 ord + 1 differ in the last bit, so one of them travels
    met = dealt(pairs, "a", "b").groupBy("a", "b").agg(F.min("ab").alias("ab"), F.min(back).alias("ba"))
    way = lambda src, dst, order: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(order).alias("nbr_ord"))
    both = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(way("a", "b", "ab"))).otherwise(F.array(way("a", "b", "ab"), way("b", "a", "ba")))
    return met.select(F.inline(both))


def outgoing(edges: DataFrame) -> DataFrame:
    """Distinct directed pairs."""
    return edges.groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.min("ord").alias("nbr_ord"))


def first_edge_per_pair(edges: DataFrame) -> DataFrame:
    """The first edge between two nodes, whatever its direction or relation."""
    pair = edges.withColumn("_a", F.least("source", "target")).withColumn("_b", F.greatest("source", "target"))
    return first_wins(pair, ["_a", "_b"], ["ord"]).drop("_a", "_b")
