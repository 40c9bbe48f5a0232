"""Degrees, statistics, PageRank, file ranking, communities and bridges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round3
from .blocks import Grid
from .build import hashed, last_wins, outgoing, top_per_group
from .propagation import propagated

ALPHA, EPSILON, MAX_ITERATIONS, MAX_SWEEPS = 0.85, 1e-6, 100, 50
#: Adjacency rows up to which one grouped task iterates in memory; larger graphs iterate by joins.
LOCAL_ROWS = 2_000_000
#: Decimals of a rank that order rows: beyond them it depends on the order of a sum, and ord decides.
RANK_DECIMALS = 12


def degrees(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """Every node with its number of distinct neighbours (a self-loop is one). Ends of adj are ids, or the nodes' numbers where nodes have these."""
    key = "number" if "number" in nodes.columns else "id"
    d = adj.groupBy(F.col("src").alias(key)).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(hashed(d), key, "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def top_nodes(nodes: DataFrame, adj: DataFrame, limit: int = 10) -> DataFrame:
    return degrees(nodes, adj).orderBy(F.desc("degree"), "ord").limit(limit).select("ord", "id", "label", "degree")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, communities, and the average degree 2E/N with parallel edges."""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"), F.countDistinct("community").alias("community_count"))
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    average = F.when(F.col("node_count") > 0, F.round(2 * F.col("edge_count") / F.col("node_count"), 1)).otherwise(F.lit(0.0))
    return n.crossJoin(e).withColumn("avg_degree", average)  # one row by one row


def _checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint where the session has a folder for it, so that iterations don't pile up lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        kept = df.persist()
        kept.count()  # so that the next steps plan over what is kept, not over the steps before
        return kept
    return df.checkpoint()


def pagerank_iterations(ids: DataFrame, links: DataFrame, iterations: int, alpha: float = ALPHA) -> DataFrame:
    """A fixed number of power iterations on a grid of links. ids: (id); links: distinct (src, dst). Nodes without links leak."""
    grid = Grid(ids, links, alpha)
    ranks = grid.start()
    for _ in range(iterations):
        ranks = grid.step(ranks)
    return grid.ranks(ranks)


def pagerank_joined(ids: DataFrame, links: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """Iterate until the L1 change is below N * epsilon; for graphs beyond one task."""
    grid = Grid(ids, links, alpha)
    ranks = _checkpointed(grid.start())
    for _ in range(max_iterations):
        was, ranks = ranks, _checkpointed(grid.step(ranks))
        if grid.change(was, ranks) < grid.n * epsilon:
            break
    out = _checkpointed(grid.ranks(ranks))
    grid.close()
    return out


def _pagerank_group(alpha: float, epsilon: float, max_iterations: int):
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf[pdf["dst"].isna()]["src"].to_numpy()
        links = pdf[pdf["dst"].notna()]
        place = pd.Series(np.arange(len(ids)), index=ids)
        a, b = place[links["src"]].to_numpy(), place[links["dst"]].to_numpy()
        n = len(ids)
        deg = np.maximum(np.bincount(a, minlength=n), 1)
        rank = np.full(n, 1.0 / n)
        for _ in range(max_iterations):
            new = (1 - alpha) / n + np.bincount(b, weights=(alpha * rank / deg)[a], minlength=n)
            change, rank = np.abs(new - rank).sum(), new
            if change < n * epsilon:
                break
        return pd.DataFrame({"id": ids, "rank": rank})

    return run


def pagerank(ids: DataFrame, links: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, max_iterations: int = MAX_ITERATIONS, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(id, rank): in one task while nodes and links together are few, by joins beyond."""
    if ids.count() + links.count() > local_rows:
        return pagerank_joined(ids, links, alpha, epsilon, max_iterations)
    rows = ids.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(links.select("src", "dst"))
    return rows.groupBy(F.lit(0).alias("one")).applyInPandas(_pagerank_group(alpha, epsilon, max_iterations), "id string, rank double")


def centrality(nodes: DataFrame, adj: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """nodes with PageRank over undirected neighbours, rounded to three decimals."""
    ranks = pagerank(nodes.select("id"), adj.select("src", "dst"), alpha, epsilon, max_iterations)
    return nodes.drop("centrality").join(ranks, "id").withColumn("centrality", round3(F.col("rank"))).select(*nodes.columns)


def communities(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """nodes with communities, exactly, by asynchronous label propagation: each node in turn takes the most frequent *other* label among its neighbours.

    Its own label's count plays no part, ties go to the label met first in neighbour order, and changes show at once. This is sequential by
    definition, so one task votes (see propagation). Ends of adj are ids, or the nodes' ord. Without edges the communities stay null.
    """
    if adj.isEmpty():
        return nodes
    if dict(adj.dtypes)["src"] == "string":
        a, b = (nodes.select(F.col("id").alias(end), F.col("ord").alias(f"{end}_ord")) for end in ("src", "dst"))
        adj = adj.join(a, "src").join(b, "dst").select(F.col("src_ord").alias("src"), F.col("dst_ord").alias("dst"), "nbr_ord")
    return nodes.drop("community").join(propagated(nodes, adj, MAX_SWEEPS), "ord").select(*nodes.columns)


def communities_parallel(nodes: DataFrame, adj: DataFrame, rounds: int = 10) -> DataFrame:
    """Synchronous label propagation (own label counts, ties to the smallest): scales, with other answers."""
    label = nodes.select("id", F.col("ord").alias("label"))
    links = adj.select("src", "dst").unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct().persist()
    for k in range(rounds):
        votes = links.join(label, F.col("dst") == F.col("id")).groupBy("src", "label").agg(F.count(F.lit(1)).alias("votes"))
        label = votes.groupBy(F.col("src").alias("id")).agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("label"))
        if k % 3 == 2:
            label = _checkpointed(label)
    return nodes.drop("community").join(label.withColumnRenamed("label", "community"), "id").select(*nodes.columns)


def import_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) between file nodes: the files of an import edge's ends, without imports of itself."""
    files = last_wins(nodes.where("type = 'file' and source_file <> ''"), ["source_file"], ["ord"]).select("source_file", F.col("id").alias("file_id"))
    of = nodes.select("id", "source_file")
    ends = edges.where("relation = 'imports'").select("source", "target", "ord")
    ends = ends.join(of.select(F.col("id").alias("source"), F.col("source_file").alias("a")), "source").join(of.select(F.col("id").alias("target"), F.col("source_file").alias("b")), "target")
    ends = ends.where("a <> '' and b <> '' and a <> b")
    left, right = files.select(F.col("source_file").alias("a"), F.col("file_id").alias("src")), files.select(F.col("source_file").alias("b"), F.col("file_id").alias("dst"))
    return ends.join(left, "a").join(right, "b").select("src", "dst").distinct()


def top_symbols(nodes: DataFrame, n: int = 6) -> DataFrame:
    """Of each file, its n most central symbols, best first: (source_file, symbols)."""
    rows = nodes.where("type <> 'file'").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    best = top_per_group(rows, ["source_file"], [F.desc("centrality"), F.asc("ord")], n)
    item = F.struct((-F.col("centrality")).alias("k"), "ord", "label", "type", "centrality")
    listed = best.groupBy("source_file").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return listed.select("source_file", F.transform("s", lambda x: F.struct(x["label"].alias("label"), x["type"].alias("type"), x["centrality"].alias("centrality"))).alias("symbols"))


def file_ranking(nodes: DataFrame, edges: DataFrame, limit: int = 40) -> DataFrame:
    """(ord, file, exact, score, symbols) of the best files by PageRank over imports; exact is what orders them."""
    files = nodes.where("type = 'file'")
    ranks = pagerank(files.select("id"), import_links(nodes, edges))
    best = files.join(ranks, "id").withColumn("rank", F.round("rank", RANK_DECIMALS)).orderBy(F.desc("rank"), "ord").limit(limit)
    none = F.array().cast("array<struct<label:string,type:string,centrality:double>>")
    return best.join(top_symbols(nodes), "source_file", "left").select("ord", F.coalesce("source_file", "label").alias("file"), F.col("rank").alias("exact"), round3(F.col("rank")).alias("score"), F.coalesce("symbols", none).alias("symbols"))


def community_best(nodes: DataFrame) -> DataFrame:
    """(community, best_id, best_label): the most central member, the first on ties."""
    rows = nodes.where("community is not null").withColumn("c", F.coalesce("centrality", F.lit(0.0)))
    return top_per_group(rows, ["community"], [F.desc("c"), F.asc("ord")], 1).select("community", F.col("id").alias("best_id"), F.col("label").alias("best_label"))


def community_overview(nodes: DataFrame, faithful_labels: bool = True) -> DataFrame:
    """(community, size, members, label, first_ord), largest first.

    With faithful labels the label is the last member with a positive centrality, or the first member: what comparing
    each member with the node whose *id* is the label so far amounts to unless an id equals a label. Otherwise
    it is the most central member.
    """
    rows = nodes.where("community is not null")
    first3 = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "label"))), 1, 3), lambda x: x["label"])
    best3 = top_per_group(rows, ["community"], [F.asc("ord")], 3).groupBy("community").agg(first3.alias("members"))
    sizes = rows.groupBy("community").agg(
        F.count(F.lit(1)).alias("size"), F.min("ord").alias("first_ord"), F.min_by("label", "ord").alias("first_label"),
        F.max_by("label", F.when(F.coalesce("centrality", F.lit(0.0)) > 0, F.col("ord"))).alias("last_label"),
    )
    out = sizes.join(best3, "community")
    if faithful_labels:
        return out.select("community", "size", "members", F.coalesce("last_label", "first_label").alias("label"), "first_ord")
    return out.join(community_best(nodes), "community").select("community", "size", "members", F.col("best_label").alias("label"), "first_ord")


def surprises(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Extracted edges between communities, in edge order: (ord, source, target, relation, reason)."""
    who = nodes.where("community is not null").select("id", "label", "community").join(community_best(nodes).select("community", "best_label"), "community")
    a = who.select(F.col("id").alias("source"), F.col("label").alias("sl"), F.col("community").alias("sc"), F.col("best_label").alias("sb"))
    b = who.select(F.col("id").alias("target"), F.col("label").alias("tl"), F.col("community").alias("tc"), F.col("best_label").alias("tb"))
    cross = edges.where("confidence = 'EXTRACTED'").join(a, "source").join(b, "target").where("sc <> tc")
    reason = F.format_string('Cross-community bridge between "%s" and "%s"', "sb", "tb")
    return cross.select("ord", F.col("sl").alias("source"), F.col("tl").alias("target"), "relation", reason.alias("reason"))


__all__ = ["centrality", "communities", "degrees", "file_ranking", "outgoing", "pagerank", "stats", "surprises", "top_nodes"]
