"""Report, suggested questions, repository map and HTML page of a graph. Only bounded aggregates reach the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.text import escape_html, token_cost
from .operators.analytics import community_overview, degrees, file_ranking, stats, surprises, top_nodes
from .operators.build import induced

MAP_BUDGET, MAP_FILES = 1500, 50
#: Paths that a repository map leaves out.
SKIPPED = (r"^tests?\/", r"^__tests__\/", r"\.test\.", r"\.spec\.", "fixtures", "node_modules", r"package\.json", "tsconfig", r"\.config\.")
VIZ_NODES, VIZ_EDGES, VIZ_LEGEND, VIZ_LIMIT = 1500, 4000, 50, 5000
#: Colours of communities, in turn.
COLOURS = tuple(f"hsl({360 * i // 25}, {60 + 20 * (i % 2)}%, {45 + 10 * (i % 3)}%)" for i in range(25))


def suggested_questions(nodes: DataFrame, edges: DataFrame, adj: DataFrame) -> list[str]:
    """At most six questions about the best connected nodes and the two largest communities."""
    top = [r["label"] for r in top_nodes(nodes, adj, 3).orderBy(F.desc("degree"), "ord").collect()]
    out = []
    if len(top) > 1:
        out.append(f"What connects **{top[0]}** with **{top[1]}**?")
    if top:
        out.append(f"Who calls **{top[0]}**, and what does it need?")
    largest = [r["members"][0] for r in community_overview(nodes).orderBy(F.desc("size"), "first_ord").limit(2).collect()]
    if len(largest) == 2:
        out.append(f"How does data get from **{largest[0]}** to **{largest[1]}**?")
    if edges.where("relation = 'imports'").limit(6).count() > 5:
        out.append("Which modules depend on the most others?")
    out.append(f"How is the `{top[0] if top else 'main'}` subsystem built?")
    out.append("Which module has the most connections?")
    return out


def connected_table(nodes: DataFrame, adj: DataFrame, limit: int = 5) -> DataFrame:
    """(ord, id, label, degree, type, source_file) of the best connected nodes, best first."""
    return degrees(nodes, adj).orderBy(F.desc("degree"), "ord").limit(limit).select("ord", "id", "label", "degree", "type", "source_file")


def report(nodes: DataFrame, edges: DataFrame, adj: DataFrame, root: str, files: DataFrame | None = None, faithful_labels: bool = True) -> str:
    s = stats(nodes, edges).first()
    lines = ["# Graph Report", "", f"Source: `{root}`", "", "## Corpus", ""]
    if files is not None:
        kinds = files.groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("o")).orderBy("o").collect()
        lines.append(f"- **Files:** {sum(k['n'] for k in kinds)}")
        if kinds:
            lines.append("- **Languages:** " + ", ".join(f"{k['n']} {k['ext']}" for k in kinds))
    average = f"{s['avg_degree']:.1f}" if s["node_count"] else "0"
    lines += ["", "## Statistics", "", "| Metric | Value |", "|---|---|", f"| Nodes | {s['node_count']} |", f"| Edges | {s['edge_count']} |", f"| Communities | {s['community_count']} |", f"| Average degree | {average} |", ""]
    lines += ["## Most connected", "", "| # | Node | Type | Connections | File |", "|---|---|---|---|---|"]
    best = connected_table(nodes, adj).collect()
    lines += [f"| {i} | **{r['label']}** | {r['type'] or '?'} | {r['degree']} | `{r['source_file'] or '?'}` |" for i, r in enumerate(best, 1)]
    lines.append("")
    if s["community_count"] > 1:
        lines += ["## Communities", "", "| Community | Size | Members |", "|---|---|---|"]
        for r in community_overview(nodes, faithful_labels).orderBy(F.desc("size"), "first_ord").toLocalIterator():
            lines.append(f"| **{r['label']}** | {r['size']} | {', '.join(r['members'])} |")
        lines.append("")
    bridges = surprises(nodes, edges).orderBy("ord").limit(10).collect()
    if bridges:
        lines += ["## Bridges", "", *(f"- **{b['source']}** → `{b['relation']}` → **{b['target']}**: {b['reason']}" for b in bridges), ""]
    lines += ["## Questions", "", *(f"- {q}" for q in suggested_questions(nodes, edges, adj)[:8]), ""]
    return "\n".join(lines)


def map_lines(ranking: DataFrame, budget: int = MAP_BUDGET) -> DataFrame:
    """(ord, line, cost, used): files in rank order until the first that passes the budget; skipped paths are free.

    ranking has at most MAP_FILES rows, so one window over all of them is small.
    """
    kept = ranking
    for p in SKIPPED:
        kept = kept.where(~F.col("file").rlike(p))
    names = F.array_join(F.transform("symbols", lambda x: x["label"]), ", ")
    line = F.concat(F.col("file"), F.when(F.size("symbols") > 0, F.concat(F.lit(" — "), names)).otherwise(""))
    costed = kept.withColumn("line", line).withColumn("cost", token_cost(F.col("line")))
    order = Window.orderBy(F.desc("exact"), "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return costed.withColumn("used", F.sum("cost").over(order)).where(F.col("used") <= budget).select("ord", "exact", "line", "cost", "used")


def repository_map(nodes: DataFrame, edges: DataFrame, budget: int = MAP_BUDGET) -> str:
    rows = map_lines(file_ranking(nodes, edges, MAP_FILES), budget).orderBy(F.desc("exact"), "ord").collect()
    return "\n".join(["## Repository map: the most important files first", "", *(r["line"] for r in rows)]) if rows else ""


def viz_nodes(nodes: DataFrame, adj: DataFrame, limit: int = VIZ_NODES) -> DataFrame:
    """The best connected nodes, files left out, with size, colour number and escaped label."""
    top = degrees(nodes.where("type <> 'file'"), adj).orderBy(F.desc("degree"), "ord").limit(limit)
    size = F.greatest(F.lit(5.0), F.least(F.lit(25.0), F.log2(F.col("degree") + 2) * 8))
    community = F.coalesce("community", F.lit(0))
    return top.select("ord", "id", escape_html(F.col("label")).alias("label"), "type", "source_file", "degree", community.alias("community"), (community % 25).alias("colour"), size.alias("size"))


def viz_edges(shown: DataFrame, edges: DataFrame, limit: int = VIZ_EDGES) -> DataFrame:
    """The first edges among the nodes shown."""
    return induced(edges, shown.select("id")).orderBy("ord").limit(limit)


def viz_legend(shown: DataFrame) -> DataFrame:
    """(community, n, label): the label is that of the best connected node."""
    return shown.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.max_by("label", F.struct("degree", -F.col("ord"))).alias("label"))


_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title><style>
body{{margin:0;font:14px sans-serif;display:flex;height:100vh}}canvas{{flex:1}}aside{{width:280px;overflow:auto;padding:8px;border-left:1px solid #ccc}}
</style></head><body><canvas id="c"></canvas><aside><input id="q" placeholder="search"><div id="hits"></div><h3>Communities</h3><div id="legend"></div><div id="info"></div></aside>
<script type="application/json" id="data">{data}</script><script>
const d=JSON.parse(document.getElementById("data").textContent),by=new Map(d.nodes.map((n,i)=>[n.id,Object.assign(n,{{x:Math.cos(i*2.4)*Math.sqrt(i+1),y:Math.sin(i*2.4)*Math.sqrt(i+1)}})])),off=new Set();
const c=document.getElementById("c"),g=c.getContext("2d"),el=(id)=>document.getElementById(id);let at=null;
function draw(){{c.width=c.clientWidth;c.height=c.clientHeight;const k=Math.min(c.width,c.height)/(2.2*Math.sqrt(d.nodes.length+1));const p=(n)=>[c.width/2+n.x*k,c.height/2+n.y*k];g.strokeStyle="#ddd";
for(const e of d.edges){{const a=by.get(e.source),b=by.get(e.target);if(off.has(a.community)||off.has(b.community))continue;g.setLineDash(e.dashed?[4,4]:[]);g.beginPath();g.moveTo(...p(a));g.lineTo(...p(b));g.stroke()}}
for(const n of d.nodes){{if(off.has(n.community))continue;g.fillStyle=d.colours[n.colour];g.beginPath();g.arc(...p(n),n===at?n.size:n.size/3,0,7);g.fill()}}}}
function show(n){{at=n;const near=d.edges.filter(e=>e.source===n.id||e.target===n.id).slice(0,30).map(e=>by.get(e.source===n.id?e.target:e.source).label);el("info").innerHTML="<h3>"+n.label+"</h3>"+n.degree+" connections<br>"+near.join("<br>");draw()}}
el("q").oninput=(e)=>{{el("hits").innerHTML="";for(const n of d.nodes.filter(n=>n.label.toLowerCase().includes(e.target.value.toLowerCase())).slice(0,15)){{const x=document.createElement("div");x.innerHTML=n.label;x.onclick=()=>show(n);el("hits").append(x)}}}};
for(const l of d.legend){{const x=document.createElement("div");x.innerHTML=l.label+" ("+l.n+")";x.style.color=d.colours[l.community%25];x.onclick=()=>{{off.has(l.community)?off.delete(l.community):off.add(l.community);draw()}};el("legend").append(x)}}
window.onresize=draw;draw();
</script></body></html>
"""


def html_page(nodes: DataFrame, edges: DataFrame, adj: DataFrame, title: str = "Knowledge graph") -> str:
    """A page of its own with at most 1500 nodes and 4000 edges; all text is escaped."""
    shown = viz_nodes(nodes, adj).persist()
    among = viz_edges(shown, edges)
    legend = viz_legend(shown).orderBy(F.desc("n"), "community").limit(VIZ_LEGEND)
    data = {
        "nodes": [r.asDict() for r in shown.orderBy(F.desc("degree"), "ord").collect()],
        "edges": [{"source": r["source"], "target": r["target"], "dashed": r["confidence"] != "EXTRACTED"} for r in among.collect()],
        "legend": [r.asDict() for r in legend.collect()],
        "colours": COLOURS,
    }
    shown.unpersist()
    return _PAGE.format(title=html.escape(title), data=json.dumps(data).replace("<", "\\u003c"))
