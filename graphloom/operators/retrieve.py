"""Scoring nodes against a question, expanding to neighbours, packing into a token budget, and explaining an entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import node_cost, node_display, node_text, plural_title, tokenize
from .build import dealt, first_edge_per_pair, hashed, induced, top_per_group

#: Characters of the result's header besides the question and the budget: they are charged first.
HEADER_CHARS = 43
MIN_SCORE, BUDGET, BONUS, UNKNOWN_IDF = 0.15, 4000, 0.3, 0.5


def tokens_of(text: str) -> list[str]:
    """The tokens of a question; the same rule as functions.text.tokenize, for one string."""
    import re

    split = re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", text))
    return [w.lower() for w in re.split("[^a-zA-Z0-9]+", split) if len(w) > 1]


def _times(term: str):
    return F.size(F.filter("tokens", lambda x: x == term))


@dataclass
class TextIndex:
    """Question-independent statistics, built once: texts (ord, id, tokens) and idf (term, df, idf), over counts (term, df) that are kept."""

    texts: DataFrame
    counts: DataFrame
    idf: DataFrame

    @classmethod
    def build(cls, nodes: DataFrame) -> TextIndex:
        """A text's terms are made distinct in its row, so that only counts travel. A null term counts the nodes without tokens."""
        tokens = tokenize(node_text())
        counts = nodes.select(F.explode_outer(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).persist(StorageLevel.MEMORY_AND_DISK)
        without = counts.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("without"))
        n = nodes.agg(F.count(F.lit(1)).alias("every")).crossJoin(without).select((F.col("every") - F.col("without")).alias("n_docs"))  # one row
        idf = counts.where("term is not null").crossJoin(F.broadcast(n)).select("term", "df", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
        texts = nodes.select("ord", "id", F.explode(F.array(tokens)).alias("tokens")).where("size(tokens) > 0")  # through explode tokens are cut once, not for the filter too
        return cls(texts, counts, idf)

    def close(self) -> None:
        """Give up what is kept."""
        self.counts.unpersist()

    def norms(self, texts: DataFrame) -> DataFrame:
        """(ord, norm) of some of the texts."""
        terms = texts.select("ord", F.explode("tokens").alias("term")).groupBy("ord", "term").agg(F.count(F.lit(1)).alias("tf"))
        return terms.join(self.idf, "term").groupBy("ord").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))

    def scores(self, question: str) -> DataFrame:
        """(ord, id, score) of every node with tokens: cosine plus 0.3 for each query token found in its text, at most 1.

        Repeated query tokens count in the query's norm and in the bonus, once in the product. The norm, which needs the weights of
        all terms of a text, is found for texts whose score depends on it: those with a query term and a bonus below 1.
        """
        asked = tokens_of(question)
        if not asked:
            return self.texts.select("ord", "id", F.lit(0.0).alias("score"))
        distinct = list(dict.fromkeys(asked))
        known = {r["term"]: r["idf"] for r in self.idf.where(F.col("term").isin(distinct)).collect()}  # a row a query token
        norm = sum(known.get(t, UNKNOWN_IDF) ** 2 for t in asked) ** 0.5
        joined = F.concat_ws(" ", "tokens")
        bonus = sum((F.when(F.contains("joined", F.lit(t)), BONUS).otherwise(0.0) for t in asked), F.lit(0.0))
        dot = sum((_times(t) * F.lit(w * w) for t, w in known.items()), F.lit(0.0))
        found = self.texts.select("ord", "id", "tokens", joined.alias("joined")).select("ord", "id", "tokens", bonus.alias("bonus"), dot.alias("dot"))
        norms = self.norms(found.where("dot > 0 and bonus < 1"))
        cosine = F.coalesce(F.col("dot") / (F.lit(norm) * F.col("norm")), F.lit(0.0))
        return found.drop("tokens").join(norms, "ord", "left").select("ord", "id", F.least(F.lit(1.0), cosine + F.col("bonus")).alias("score"))


def candidate_sequence(ranked: DataFrame, adj: DataFrame, min_score: float, best: DataFrame | None = None) -> DataFrame:
    """The order in which nodes are offered to the budget: each ranked node, then its neighbours that are good enough.

    ranked: (ord, id, score) above the threshold. Each node is kept at its first place, since a refused one stays refused.
    best: the first rows of ranked; what they and their neighbours make is the beginning of the sequence.
    """
    best = ranked if best is None else best
    own = best.select("id", (-F.col("score")).alias("k1"), F.col("ord").alias("k2"), F.lit(0).alias("k3"), F.lit(0).cast("long").alias("k4"))
    other = ranked.where(F.col("score") >= min_score * 0.5).select(F.col("id").alias("nid"))
    near = adj.join(hashed(best), F.col("id") == F.col("src")).join(hashed(other), F.col("dst") == F.col("nid"))
    near = near.select(F.col("nid").alias("id"), (-F.col("score")).alias("k1"), F.col("ord").alias("k2"), F.lit(1).alias("k3"), F.col("nbr_ord").alias("k4"))
    return dealt(own.unionByName(near), "id").groupBy("id").agg(F.min(F.struct("k1", "k2", "k3", "k4")).alias("place"))


#: The greedy fold: an item that would pass 95% of the budget is refused, and at 90% the rest is not looked at.
PACK = """
aggregate({items}, cast(struct({start} as used, array() as taken) as struct<used:double,taken:array<{kind}>>),
  (s, x) -> case when s.used >= {budget} * 0.9 or s.used + x.cost > {budget} * 0.95 then s
                 else named_struct('used', s.used + x.cost, 'taken', concat(s.taken, array(x.key))) end)
"""


def pack_expression(items: str, start: str, budget: str, kind: str = "string") -> str:
    return PACK.format(items=items, start=start, budget=budget, kind=kind)


def full(used: float, budget: int) -> bool:
    return used >= budget * 0.9


def header_cost(question: str, budget: int) -> int:
    return -(-(HEADER_CHARS + len(question.encode("utf-16-le")) // 2 + len(str(budget))) // 4)


def pack(sequence: DataFrame, costs: DataFrame, start: int, budget: int, first: int = 4096) -> tuple[int, list[str]]:
    """Greedy selection over an ordered sequence (id, place): tokens used and ids in order.

    The fold runs on the best rows first; while neither the budget is met nor the sequence exhausted, over more of them.
    """
    rows = sequence.join(costs, "id").where(F.col("cost") <= budget * 0.95).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while True:
            best = rows.orderBy("place").limit(first)
            items = best.agg(F.array_sort(F.collect_list(F.struct("place", F.col("id").alias("key"), "cost"))).alias("items"))
            r = items.select(F.size("items").alias("n"), F.expr(pack_expression("items", str(start), str(budget))).alias("s")).first()
            if r["n"] < first or full(r["s"]["used"], budget):
                return int(r["s"]["used"]), list(r["s"]["taken"])
            first *= 4
    finally:
        rows.unpersist()


def _bfs(ranked: DataFrame, adj: DataFrame, costs: DataFrame, start: int, budget: int, min_score: float, first: int = 4096) -> tuple[int, list[str]]:
    """Tokens used and ids in order. The best nodes come first with all their neighbours: while they don't fill the budget, more of them are taken, up to all."""
    every = ranked.count()
    while True:
        best = ranked if first >= every else ranked.orderBy(F.desc("score"), "ord").limit(first)
        used, ids = pack(candidate_sequence(ranked, adj, min_score, best), costs, start, budget)
        if first >= every or full(used, budget):
            return used, ids
        first *= 16


@dataclass
class Result:
    question: str
    mode: str
    nodes: DataFrame
    edges: DataFrame
    tokens_used: int
    budget: int
    coverage: float

    def summary(self) -> DataFrame:
        spark = self.nodes.sparkSession
        return spark.createDataFrame([(self.question, self.mode, self.tokens_used, self.budget, self.coverage)], "question string, mode string, tokens_used int, budget int, coverage double")


#: Fan-out and depth of the walk, and the most nodes that it can visit.
FAN, DEPTH = 3, 5
WALK = sum(FAN**k for k in range(DEPTH + 1))


def _dfs(adj: DataFrame, scores: DataFrame, costs: DataFrame, start: str, used: int, budget: int) -> tuple[int, list[str]]:
    """From the best node: up to five steps deep, three best unvisited neighbours each.

    At most WALK nodes are visited, so a node's WALK + FAN best neighbours hold its best unvisited ones. They are fetched for many nodes in
    one job: for the one that the walk has reached, and for those that it is about to reach.
    """
    chosen: list[str] = []
    visited: set[str] = set()
    links = adj.select("src", "dst", "nbr_ord").persist(StorageLevel.MEMORY_AND_DISK)
    known = costs.join(hashed(scores), "id", "left").select(F.col("id").alias("dst"), F.coalesce("score", F.lit(0.0)).alias("score"), "cost").persist(StorageLevel.MEMORY_AND_DISK)
    cost = {start: costs.where(F.col("id") == start).first()["cost"]}
    best: dict[str, list[str]] = {}

    def neighbours(v: str) -> list[str]:
        if v not in best:
            soon = [u for found in best.values() for u in [x for x in found if x not in visited][: 2 * FAN] if u not in best]
            wanted = [v, *list(dict.fromkeys(soon))[:WALK]]
            near = links.where(F.col("src").isin(wanted)).join(known, "dst")
            top = top_per_group(near, ["src"], [F.desc("score"), F.asc("nbr_ord")], WALK + FAN)
            best.update((u, []) for u in wanted)
            for r in top.orderBy("src", F.desc("score"), "nbr_ord").collect():
                best[r["src"]].append(r["dst"])
                cost[r["dst"]] = r["cost"]
        return [u for u in best[v] if u not in visited][:FAN]

    def visit(v: str, depth: int) -> None:
        nonlocal used
        if depth > DEPTH or used >= budget * 0.9:
            return
        visited.add(v)
        if used + cost[v] <= budget * 0.95:
            chosen.append(v)
            used += cost[v]
        for u in neighbours(v) if depth < DEPTH and used < budget * 0.9 else ():
            if u not in visited:
                visit(u, depth + 1)

    visit(start, 0)
    links.unpersist()
    known.unpersist()
    return used, chosen


def query(nodes: DataFrame, edges: DataFrame, adj: DataFrame, question: str, budget: int = BUDGET, mode: str = "bfs", min_score: float = MIN_SCORE, index: TextIndex | None = None) -> Result:
    """The nodes that answer a question within a token budget, and the edges among them."""
    if mode not in ("bfs", "dfs"):
        raise ValueError(f"mode is bfs or dfs, not {mode!r}")
    spark: SparkSession = nodes.sparkSession
    total = nodes.count()
    none = nodes.limit(0)
    if total == 0:
        return Result(question, mode, none, edges.limit(0), 0, budget, 0.0)
    own = None if index else TextIndex.build(nodes)
    index = index or own
    ranked = index.scores(question).where(F.col("score") >= min_score).persist(StorageLevel.MEMORY_AND_DISK)
    costs = nodes.select("id", node_cost().alias("cost"))
    used = header_cost(question, budget)
    if mode == "bfs":
        used, ids = (used, []) if full(used, budget) else _bfs(ranked, adj, costs, used, budget, min_score)
    else:
        best = ranked.orderBy(F.desc("score"), "ord").first()
        used, ids = (used, []) if best is None else _dfs(adj, ranked.select("id", "score"), costs, best["id"], used, budget)
    ranked.unpersist()
    if own:
        own.close()  # what follows reads the graph only
    chosen = spark.createDataFrame([(v, i) for i, v in enumerate(ids)], "id string, pos int")  # bounded by the budget
    found = nodes.join(F.broadcast(chosen), "id").orderBy("pos")
    among = first_edge_per_pair(induced(edges, chosen.select("id"))).orderBy("ord")
    return Result(question, mode, found, among, used, budget, len(ids) / total)


def format_result(r: Result) -> str:
    """Markdown of a result: nodes by type (files are not shown), ten relationships, and a hint."""
    rows = r.nodes.select("pos", "id", "type", "label", plural_title(F.col("type")).alias("title"), node_display(False).alias("text")).orderBy("pos").collect()
    lines = [f'## Graph query: "{r.question}"', f"_{len(rows)} nodes · {r.tokens_used}/{r.budget} tokens ({r.coverage * 100:.1f}% coverage)_", ""]
    kinds = list(dict.fromkeys(x["type"] for x in rows))
    for kind in kinds:
        if kind != "file":
            members = [x for x in rows if x["type"] == kind]
            lines.append(f"### {members[0]['title']}")
            for x in members:
                lines += [x["text"], ""]
    label = {x["id"]: x["label"] for x in rows}
    edges = r.edges.orderBy("ord").limit(10).collect()
    if edges:
        lines.append("### Key Relationships")
        for e in edges:
            lines.append(f"- {label[e['source']]} → **{e['relation']}** → {label[e['target']]}{' _[inferred]_' if e['confidence'] == 'INFERRED' else ''}")
    if rows and r.coverage < 1:
        lines += ["", "---", f"{len(rows)} nodes shown; a larger budget may include more connected nodes"]
    return "\n".join(lines)


def matches(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes whose label or id contains the name, whatever its case; no wildcards."""
    wanted = F.lit(name.lower())
    return nodes.where(F.contains(F.lower("label"), wanted) | F.contains(F.lower("id"), wanted))


def relationships(nodes: DataFrame, edges: DataFrame, node_id: str, shown: int = 15) -> DataFrame:
    """Incident edges by relation, at most `shown` each: (relation, relation_ord, total, rn, direction, other, type, confidence, ord)."""
    touching = edges.where((F.col("source") == node_id) | (F.col("target") == node_id))
    out = F.col("source") == node_id
    sides = touching.select("ord", "relation", "confidence", F.when(out, "→").otherwise("←").alias("direction"), F.when(out, F.col("target")).otherwise(F.col("source")).alias("other_id"))
    named = sides.join(nodes.select(F.col("id").alias("other_id"), F.col("label").alias("other"), "type"), "other_id")
    by = Window.partitionBy("relation")
    numbered = named.withColumn("total", F.count(F.lit(1)).over(by)).withColumn("relation_ord", F.min("ord").over(by)).withColumn("rn", F.row_number().over(by.orderBy("ord")))
    return numbered.where(F.col("rn") <= shown).select("relation", "relation_ord", "total", "rn", "direction", "other", "type", "confidence", "ord")


def explain(nodes: DataFrame, edges: DataFrame, adj: DataFrame, name: str) -> str:
    """Markdown about the first entity that matches a name."""
    node = matches(nodes, name).orderBy("ord").first()
    if node is None:
        return f'No entity matching "{name}" found in the knowledge graph.'
    degree = adj.where(F.col("src") == node["id"]).count()
    at = f" {node['source_location']}" if node["source_location"] else ""
    lines = [f"## {node['label']} ({node['type']})", f"- **File:** `{node['source_file']}`{at}", f"- **Community:** {'—' if node['community'] is None else node['community']}", f"- **Connections:** {degree}"]
    if node["description"]:
        lines.append(f"- **Description:** {node['description']}")
    lines.append("")
    rows = relationships(nodes, edges, node["id"]).orderBy("relation_ord", "rn").collect()
    if rows:
        lines.append("### Relationships")
    last = None
    for k, r in enumerate(rows):
        if r["relation"] != last:
            lines.append(f"#### {r['relation']} ({r['total']})")
            last = r["relation"]
        lines.append(f"- {r['direction']} **{r['other']}** ({r['type']}) _{r['confidence']}_")
        if k + 1 == len(rows) or rows[k + 1]["relation"] != last:
            if r["total"] > r["rn"]:
                lines.append(f"  _... and {r['total'] - r['rn']} more_")
            lines.append("")
    return "\n".join(lines)


__all__ = ["Result", "TextIndex", "explain", "format_result", "matches", "query", "relationships", "top_per_group"]
