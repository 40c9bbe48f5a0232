"""The engine's entry points: build a project's graph, query it, explain an entity, say where it stands."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..extract.run import extract_project
from ..operators.analytics import centrality, communities, communities_parallel, stats
from ..operators.build import adjacency, build, merge
from ..operators.retrieve import BUDGET, MIN_SCORE, explain, format_result, query
from ..report import VIZ_LIMIT, html_page, report, repository_map
from ..sources.files import MAX_BYTES, MAX_FILES, list_files, staleness
from ..sources.graph_io import graph_exists, read_graph, write_graph

OUT = "graph-out"


@dataclass
class Outcome:
    text: str
    details: dict = field(default_factory=dict)
    is_error: bool = False


@dataclass
class Project:
    """A source tree and the graph beside it."""

    spark: SparkSession
    root: str

    @property
    def out(self) -> str:
        return os.path.join(os.path.abspath(self.root), OUT)

    @property
    def graph(self) -> str:
        return f"file://{self.out}/graph"

    def load(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        nodes, edges = read_graph(self.spark, self.graph)
        return nodes, edges, adjacency(edges)

    def build(self, force: bool = False, directed: bool = False, no_viz: bool = False, no_report: bool = False, update: bool = False, dedup_edges: bool = False, complete: bool = False, max_files: int | None = MAX_FILES, max_bytes: int | None = MAX_BYTES, parallel: bool = False) -> Outcome:
        """directed is kept in the details only: no operator depends on it.

        max_files and max_bytes are the compared limits; None lifts them. parallel finds communities by another operator, which scales.
        """
        try:
            exists = graph_exists(self.spark, self.graph)
            if exists and not force and not update:
                return Outcome("A graph is there already; pass force or update to build again.", {"skipped": True})
            files, nodes, edges, counts = extract_project(self.spark, self.root, f"file://{self.out}/cache", force, complete, max_files, max_bytes)
            n_files = files.count()
            if n_files == 0:
                return Outcome("No code files were found.", {"files": 0})
            if update and exists:
                old_nodes, old_edges, _ = self.load()
                nodes, edges = merge(old_nodes, old_edges, nodes, edges, dedup_edges)
            else:
                nodes, edges = build(nodes, edges)
            adj = adjacency(edges).persist()
            nodes = (communities_parallel if parallel else communities)(centrality(nodes, adj), adj)
            write_graph(nodes, edges, self.graph)
            nodes, edges, adj = self.load()
            s = stats(nodes, edges).first()
            if not no_report:
                with open(os.path.join(self.out, "GRAPH_REPORT.md"), "w", encoding="utf-8") as f:
                    f.write(report(nodes, edges, adj, os.path.abspath(self.root), files))
            if not no_viz and s["node_count"] <= VIZ_LIMIT:
                with open(os.path.join(self.out, "graph.html"), "w", encoding="utf-8") as f:
                    f.write(html_page(nodes, edges, adj))
            details = {"files": n_files, "nodes": s["node_count"], "edges": s["edge_count"], "communities": s["community_count"], "mode": "directed" if directed else "undirected", **counts}
            return Outcome("\n".join(["| Metric | Value |", "|---|---|", *(f"| {k} | {v} |" for k, v in details.items())]), details)
        except (FileNotFoundError, ValueError) as e:
            return Outcome(f"Build failed: {e}", {"error": str(e)}, True)

    def query(self, question: str, budget: int = BUDGET, min_score: float = MIN_SCORE, mode: str = "bfs") -> Outcome:
        if not graph_exists(self.spark, self.graph):
            return Outcome("There is no graph yet; build it first.", is_error=True)
        r = query(*self.load(), question, budget, mode, min_score)
        return Outcome(format_result(r), {"tokens_used": r.tokens_used, "coverage": r.coverage})

    def explain(self, name: str) -> Outcome:
        if not graph_exists(self.spark, self.graph):
            return Outcome("There is no graph yet; build it first.", is_error=True)
        return Outcome(explain(*self.load(), name))

    def map(self) -> str:
        if not graph_exists(self.spark, self.graph):
            return ""
        nodes, edges, _ = self.load()
        return repository_map(nodes, edges)

    def stale(self) -> tuple[bool, int]:
        """Whether any of the first 200 files is newer than the graph, and how many are."""
        if not graph_exists(self.spark, self.graph):
            return False, 0
        built = max(os.stat(os.path.join(self.out, "graph", v, "_READY")).st_mtime for v in os.listdir(os.path.join(self.out, "graph")) if v.startswith("v")) * 1000
        r = staleness(list_files(self.spark, self.root), built).first()
        return r["stale"], r["count"]

    def status(self) -> str:
        if not graph_exists(self.spark, self.graph):
            return "No graph."
        nodes, edges, _ = self.load()
        s = stats(nodes, edges).first()
        stale, n = self.stale()
        return f"{s['node_count']} nodes, {s['edge_count']} edges, {s['community_count']} communities" + (f"; {n} files are newer ({time.strftime('%Y-%m-%d')})" if stale else "")
