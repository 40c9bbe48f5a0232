"""The engine's operators bound to the supplied tables, by name, each with its SQL where SQL can say it.

Everything runs over whole tables; a limit occurs only where it is the operator (a top-k, a budget).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import escape_html, extension, node_cost, node_display, node_id, one_line, plural_title, token_cost, tokenize
from ..operators import analytics as an
from ..operators import build as gb
from ..operators import retrieve as rt
from ..report import connected_table, map_lines, viz_edges, viz_legend, viz_nodes
from ..sources.files import by_extension, content_hash, staleness
from . import star

QUESTION, ASK_BUDGET = "red widget and steel ring of Supplier", 1200

# ---- SQL of the star graph

NODES_SQL = """
n_region as (select r_regionkey::bigint as ord, 'region_' || r_regionkey as id, r_name as label, 'region' as type, 'region_' || r_regionkey as source_file from region),
n_nation as (select 1000000000000 + n_nationkey, 'nation_' || n_nationkey, n_name, 'nation', 'region_' || n_regionkey from nation),
n_customer as (select 2000000000000 + c_custkey, 'customer_' || c_custkey, c_name, 'customer', 'nation_' || c_nationkey from customer),
n_supplier as (select 3000000000000 + s_suppkey, 'supplier_' || s_suppkey, s_name, 'supplier', 'nation_' || s_nationkey from supplier),
n_part as (select 4000000000000 + p_partkey, 'part_' || p_partkey, p_name, 'part', 'part_' || p_partkey from part),
nodes as (from n_region union all from n_nation union all from n_customer union all from n_supplier union all from n_part)"""
CONTAINS_SQL = """
contained as (select 1000000000000 + n_nationkey as ord, 'region_' || n_regionkey as source, 'nation_' || n_nationkey as target, 'contains' as relation, 'EXTRACTED' as confidence from nation
 union all select 2000000000000 + c_custkey, 'nation_' || c_nationkey, 'customer_' || c_custkey, 'contains', 'EXTRACTED' from customer
 union all select 3000000000000 + s_suppkey, 'nation_' || s_nationkey, 'supplier_' || s_suppkey, 'contains', 'EXTRACTED' from supplier)"""
EDGES_SQL = CONTAINS_SQL + """,
edges as (from contained union all select 5000000000000 + l_suppkey * 1000000 + l_partkey, 'supplier_' || l_suppkey, 'part_' || l_partkey, 'calls', 'INFERRED' from (select distinct l_suppkey, l_partkey from lineitem))"""
ADJ_SQL = """
adj as (select src, dst, min(o) as nbr_ord from (select source as src, target as dst, 2 * ord as o from edges union all select target, source, 2 * ord + 1 from edges) group by all)"""
GRAPH_SQL = f"{NODES_SQL},{EDGES_SQL},{ADJ_SQL}"
TOKENS_SQL = "list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+'), lambda w: lower(w)), lambda w: length(w) > 1)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = star.star_nodes(spark, d), star.star_edges(spark, d)
    return nodes, edges, star.star_adjacency(spark, d)


def numbered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with numbers, and their adjacency by numbers: what degrees need."""
    return star.numbered_nodes(spark, d), star.star_adjacency(spark, d, "number")


# ---- building

@register(f"with {GRAPH_SQL}, d as (select src, count(*) as degree from adj group by 1) select id, label, coalesce(degree, 0)::bigint as degree from nodes left join d on src = id order by degree desc, ord limit 10")
def degree_topk(spark, d):
    nodes, adj = numbered(spark, d)
    return an.top_nodes(nodes, adj, 10).select("id", "label", "degree")


@register(f"with {NODES_SQL} select ord, id, label, type, source_file from nodes")
def node_build(spark, d):
    return star.star_nodes(spark, d).select("ord", "id", "label", "type", "source_file")


@register(f"with {EDGES_SQL} select ord, source, target, relation, confidence, case when relation = 'calls' then 0.85::double end as confidence_score from edges")
def edge_build(spark, d):
    return star.star_edges(spark, d)


@register(f"with {NODES_SQL}, {EDGES_SQL}, kept as (select id from nodes where id <> 'nation_3' and not (type = 'supplier' and ord >= 3000000000050)) select source, target, relation from edges where source in (from kept) and target in (from kept)")
def dangling_filter(spark, d):
    nodes, edges, _ = graph(spark, d)
    kept = nodes.where(f"id <> 'nation_3' and not (type = 'supplier' and ord >= {3 * star.STEP + 50})")
    return gb.drop_dangling(edges, kept).select("source", "target", "relation")


@register(f"""with {NODES_SQL}, again as (select ord + 9000000000000 as ord, id, 'new ' || label as label from nodes where type = 'supplier' or (type = 'part' and ord % 3 = 0)),
 every as (select ord, id, label from nodes where type <> 'customer' union all from again) select min(ord) as ord, id, arg_max(label, ord) as label from every group by id""")
def build_nodes(spark, d):
    nodes, edges, _ = graph(spark, d)
    again = nodes.where("type = 'supplier' or (type = 'part' and ord % 3 = 0)").withColumn("ord", F.col("ord") + 9 * star.STEP).withColumn("label", F.concat(F.lit("new "), "label"))
    return gb.build(nodes.where("type <> 'customer'").unionByName(again), edges)[0].select("ord", "id", "label")


@register(f"with {NODES_SQL}, {EDGES_SQL} select relation, count(*) as n from edges where source in (select id from nodes where type <> 'customer') and target in (select id from nodes where type <> 'customer') group by 1")
def build_edges(spark, d):
    nodes, edges, _ = graph(spark, d)
    return gb.build(nodes.where("type <> 'customer'"), edges)[1].groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@register(f"with {EDGES_SQL}, {ADJ_SQL} select src, dst, nbr_ord from adj")
def adjacency(spark, d):
    return star.star_adjacency(spark, d)


@register(f"with {NODES_SQL}, {EDGES_SQL} select (select count(*) from nodes) as node_count, (select count(distinct source_file) from nodes where type in ('nation', 'customer')) as community_count, (select count(*) from edges) as edge_count, round(2.0 * (select count(*) from edges) / (select count(*) from nodes), 1)::double as avg_degree")
def graph_stats(spark, d):
    nodes, edges, _ = graph(spark, d)
    # nations and customers are in the community of their owner
    owner = F.regexp_extract("source_file", r"(\d+)$", 1).cast("int")
    grouped = nodes.withColumn("community", F.when(F.col("type") == "nation", owner + 1000).when(F.col("type") == "customer", owner))
    return an.stats(grouped, edges)


@register(f"""with {NODES_SQL}, base as (select * from nodes where type <> 'part' or ord < 4000000001000), extra as (select * from nodes where type = 'part' and ord >= 4000000000500),
fresh as (select ord + (select max(ord) from base) + 1 as ord, id, 'new ' || label as label from extra where id not in (select id from base))
select ord, id, label from base union all select ord, id, label from fresh""")
def merge_incremental(spark, d):
    nodes, edges, _ = graph(spark, d)
    first = 4 * star.STEP
    base = nodes.where(f"type <> 'part' or ord < {first + 1000}")
    more = nodes.where(f"type = 'part' and ord >= {first + 500}").withColumn("label", F.concat(F.lit("new "), "label"))
    return gb.merge(base, edges.limit(0), more, edges.limit(0))[0].select("ord", "id", "label")


@register(f"""with {NODES_SQL}, {EDGES_SQL}, base as (select * from edges where relation = 'contains'),
again as (select source, target, relation from edges where target not like 'part\\_%' escape '\\' or source < 'supplier_5')
select relation, count(*) as n, count(distinct source || target) as pairs from (select source, target, relation from base union all from again) group by 1""")
def merge_duplicates_edges(spark, d):
    nodes, edges, _ = graph(spark, d)
    again = edges.where("target not like 'part\\_%' or source < 'supplier_5'")
    merged = gb.merge(nodes, edges.where("relation = 'contains'"), nodes.limit(0), again)[1]
    pairs = gb.dealt(merged.select("relation", F.concat("source", "target").alias("pair")), "relation", "pair").groupBy("relation", "pair").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("relation").agg(F.sum("n").alias("n"), F.count("pair").alias("pairs"))


@register(f"""with {NODES_SQL}, {EDGES_SQL}, base as (select * from edges where relation = 'contains')
select relation, count(*) as n from (select relation from base union all select relation from edges e where not exists (select 1 from base b where b.source = e.source and b.target = e.target and b.relation = e.relation)) group by 1""")
def merge_without_duplicates(spark, d):
    nodes, edges, _ = graph(spark, d)
    merged = gb.merge(nodes, edges.where("relation = 'contains'"), nodes.limit(0), edges, dedup_edges=True)[1]
    return merged.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@register("select min(doc_id) as doc_id, sha256(text) as key from documents group by 2")
def first_wins_dedup(spark, d):
    docs = star.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return gb.first_wins(docs, ["key"], ["doc_id"])


@register("select max(doc_id) as doc_id, lang, source from documents group by 2, 3")
def last_wins_dedup(spark, d):
    return gb.last_wins(star.table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"])


@register("""with e as (select least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b, l_orderkey * 10 + l_linenumber as ord from lineitem)
select a, b, min(ord) as ord from e group by 1, 2""")
def first_edge_per_pair(spark, d):
    e = star.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return gb.first_edge_per_pair(e).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "ord")


@register(f"with {NODES_SQL}, {EDGES_SQL}, c as (select id from nodes where type in ('supplier', 'part') or source_file = 'nation_1') select source, target, relation from edges where source in (from c) and target in (from c)")
def induced_subgraph(spark, d):
    nodes, edges, _ = graph(spark, d)
    return gb.induced(edges, nodes.where("type in ('supplier', 'part') or source_file = 'nation_1'")).select("source", "target", "relation")


@register("""with recursive e as (select 'region_' || n_regionkey as a, 'nation_' || n_nationkey as b from nation union all select 'nation_' || c_nationkey, 'customer_' || c_custkey from customer union all select 'nation_' || s_nationkey, 'supplier_' || s_suppkey from supplier),
r as (select a as start, b as node, 1 as hops from e union select r.start, e.b, r.hops + 1 from r join e on e.a = r.node where r.hops < 2) select start, node, min(hops) as hops from r group by 1, 2""")
def neighbourhood_2hop(spark, d):
    e = star.contains_edges(spark, d).select("source", "target")
    far = e.alias("x").join(e.alias("y"), F.col("x.target") == F.col("y.source")).select(F.col("x.source").alias("start"), F.col("y.target").alias("node"), F.lit(2).alias("hops"))
    near = e.select(F.col("source").alias("start"), F.col("target").alias("node"), F.lit(1).alias("hops"))
    return near.unionByName(far).groupBy("start", "node").agg(F.min("hops").alias("hops"))


# ---- analytics

def _pagerank_sql(ids: str, links: str, steps: int) -> str:
    return f"""ids as ({ids}), links as ({links}), n as (select count(*)::double as n from ids), w as (select src, dst, count(*) over (partition by src) as deg from links),
 pr as (select 0 as k, id, 1.0 / n as rank from ids, n
  union all select k + 1, id, sum(part) from (select k, id, 0.15 / n as part from pr, n where k < {steps} union all select k, w.dst, 0.85 * rank / deg from pr join w on w.src = pr.id where k < {steps}) group by k, id)"""


@register("with recursive " + _pagerank_sql("select 'supplier_' || s_suppkey as id from supplier union all select 'part_' || p_partkey from part", "select distinct 'supplier_' || l_suppkey as src, 'part_' || l_partkey as dst from lineitem union select distinct 'part_' || l_partkey, 'supplier_' || l_suppkey from lineitem", 10) + " select id, round(rank, 9) as rank from pr where k = 10")
def pagerank_10(spark, d):
    links = gb.adjacency(star.calls_links(spark, d)).select("src", "dst")
    return an.pagerank_iterations(star.numbers_of(spark, d, ("supplier", "part")), links, 10).select(star.id_of("id").alias("id"), F.round("rank", 9).alias("rank"))


_FLOW_SQL = """flow as (select c_nationkey as a, s_nationkey as b, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2),
 top5 as (select a, b, n, row_number() over (partition by a order by n desc, b) as rn from flow qualify rn <= 5)"""


def import_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations as files that import the five nations they buy most from; their customers as symbols, balance as centrality."""
    files = star.nodes_of(spark, d, "nation").withColumn("type", F.lit("file")).withColumn("source_file", F.col("label"))
    names = files.select(F.col("id").alias("owner"), F.col("label").alias("file"))
    balance = star.table(spark, d, "customer").select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_acctbal") / 10000).alias("centrality"))
    symbols = star.nodes_of(spark, d, "customer").drop("centrality").join(balance, "id").join(names, F.col("source_file") == F.col("owner")).withColumn("source_file", F.col("file")).select(*files.columns)
    flow = gb.top_per_group(star.nation_flow(spark, d), ["a"], [F.desc("n"), F.asc("b")], 5)
    name = lambda c: F.concat(F.lit("nation_"), F.col(c).cast("string"))
    edges = flow.select((F.col("a") * 100 + F.col("b")).cast("long").alias("ord"), name("a").alias("source"), name("b").alias("target"), F.lit("imports").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(None).cast("double").alias("confidence_score"))
    return files.unionByName(symbols), edges


@register(f"with {_FLOW_SQL} select 'nation_' || a as src, 'nation_' || b as dst from top5")
def import_links(spark, d):
    return an.import_links(*import_graph(spark, d))


@register(f"with recursive {_FLOW_SQL}, " + _pagerank_sql("select 'nation_' || n_nationkey as id from nation", "select 'nation_' || a as src, 'nation_' || b as dst from top5", 100) + """,
 change as (select y.k, sum(abs(x.rank - y.rank)) as diff from pr x join pr y on x.id = y.id and y.k = x.k + 1 group by 1),
 stop as (select coalesce(min(k), 100) as k from change, n where diff < n * 1e-6)
 select n_name as file, round(rank, 3) as score from pr join stop using (k) join nation on id = 'nation_' || n_nationkey order by round(rank, 12) desc, n_nationkey limit 40""")
def file_rank(spark, d):
    return an.file_ranking(*import_graph(spark, d), 40).select("file", F.round("score", 3).alias("score"))


@register(f"with recursive {_FLOW_SQL}, " + _pagerank_sql("select 'nation_' || n_nationkey as id from nation", "select distinct 'nation_' || a as src, 'nation_' || b as dst from (select a, b from top5 union select b, a from top5)", 100) + """,
 change as (select y.k, sum(abs(x.rank - y.rank)) as diff from pr x join pr y on x.id = y.id and y.k = x.k + 1 group by 1),
 stop as (select coalesce(min(k), 100) as k from change, n where diff < n * 1e-6)
 select id, floor(rank * 1000 + 0.5) / 1000 as centrality from pr join stop using (k)""")
def centrality(spark, d):
    nodes, edges = import_graph(spark, d)
    return an.centrality(nodes.where("type = 'file'"), gb.adjacency(edges)).select("id", "centrality")


@register("""with c as (select n_name as source_file, c_name as label, c_acctbal / 10000 as centrality, row_number() over (partition by n_name order by c_acctbal / 10000 desc, c_custkey) as rn from customer join nation on c_nationkey = n_nationkey)
select source_file, string_agg(label, ', ' order by rn) as symbols, round(max(centrality), 6) as best from c where rn <= 6 group by 1""")
def top_symbols(spark, d):
    s = an.top_symbols(import_graph(spark, d)[0])
    return s.select("source_file", F.array_join(F.transform("symbols", lambda x: x["label"]), ", ").alias("symbols"), F.round(F.element_at("symbols", 1)["centrality"], 6).alias("best"))


@register(f"with recursive {_FLOW_SQL}, " + _pagerank_sql("select 'nation_' || n_nationkey as id from nation", "select 'nation_' || a as src, 'nation_' || b as dst from top5", 100) + """,
 change as (select y.k, sum(abs(x.rank - y.rank)) as diff from pr x join pr y on x.id = y.id and y.k = x.k + 1 group by 1),
 stop as (select coalesce(min(k), 100) as k from change, n where diff < n * 1e-6),
 sym as (select n_name as file, c_name as label, row_number() over (partition by n_name order by c_acctbal / 10000 desc, c_custkey) as rn from customer join nation on c_nationkey = n_nationkey qualify rn <= 6),
 line as (select n_nationkey, rank, n_name || coalesce(' — ' || string_agg(label, ', ' order by rn), '') as line from pr join stop using (k) join nation on id = 'nation_' || n_nationkey left join sym on file = n_name group by 1, 2, n_name),
 cost as (select *, ceil(length(line) / 4)::int as cost from line), used as (select *, sum(cost) over (order by round(rank, 12) desc, n_nationkey) as used from cost)
 select line, cost, used::bigint as used from used where used <= 1500""")
def repository_map(spark, d):
    return map_lines(an.file_ranking(*import_graph(spark, d), 50)).select("line", "cost", "used")


#: What a nation's file is called here: some names are ones that a map leaves out.
PLACES = ("tests/{}", "src/{}", "src/{}.test.x", "src/{}", "package.json/{}", "src/{}", "src/{}.config.x")


@register(r"""with n as (select n_nationkey, ['tests/', 'src/', 'src/', 'src/', 'package.json/', 'src/', 'src/'][n_nationkey % 7 + 1] || n_name || ['', '', '.test.x', '', '', '', '.config.x'][n_nationkey % 7 + 1] as file from nation),
 l as (select n_nationkey, file, ceil(length(file) / 4)::int as cost from n where not regexp_matches(file, '^tests?/|\.test\.|package\.json|\.config\.')), u as (select *, sum(cost) over (order by n_nationkey) as used from l)
select file as line, cost, used::bigint as used from u where used <= 40""")
def map_skips(spark, d):
    name = F.element_at(F.array(*[F.lit(p) for p in PLACES]), F.col("n_nationkey") % 7 + 1)
    none = F.array().cast("array<struct<label:string,type:string,centrality:double>>")
    ranking = star.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.replace(name, F.lit("{}"), F.col("n_name")).alias("file"), F.lit(0.5).alias("exact"), none.alias("symbols"))
    return map_lines(ranking, 40).select("line", "cost", "used")


@register()
def communities(spark, d):
    return an.communities(star.star_nodes(spark, d), star.star_adjacency(spark, d, "ord")).select("id", "community")


#: A row a node looked at: the labels of all, whether one moved in this sweep, and the sweep; the vote goes to the label met most, then first.
@register(f"""with recursive {_FLOW_SQL}, e as (select a * 100 + b as ord, a, b from top5),
 adj as (select src, dst, min(o) as o from (select a as src, b as dst, 2 * ord as o from e union all select b, a, 2 * ord + 1 from e) group by all),
 n as (select row_number() over (order by n_nationkey) - 1 as i, n_nationkey as k, (select count(*) from nation) as n from nation),
 met as (select n.i, list(m.i order by adj.o) as us from n join adj on adj.src = n.k join n m on m.k = adj.dst group by 1),
 near as (select n.i, n.n, coalesce(us, []) as us from n left join met on met.i = n.i),
 run as (select 0 as step, 0 as sweep, false as moved, true as was, (select list(i order by i) from n) as labels
  union all select step + 1, case when last then sweep + 1 else sweep end, not last and (moved or best is not null), case when last then moved or best is not null else was end, case when best is null then labels else list_concat(list_append(labels[1:i], best), labels[i + 2:n]) end
  from (select *, list_max(list_filter(list_transform(range(1, len(ls) + 1), lambda p: {{'votes': len(list_filter(ls, lambda x: x = ls[p])), 'place': -p, 'label': ls[p]}}), lambda x: x.label <> labels[i + 1])).label as best
   from (select run.*, i, n, i = n - 1 as last, list_transform(us, lambda u: labels[u + 1]) as ls from run join near on i = step % n where sweep < 50 and (i > 0 or step = 0 or was))) ),
 done as (select labels from run order by step desc limit 1)
select 'nation_' || k as id, labels[i + 1]::int as community from n, done""")
def communities_imports(spark, d):
    nodes, edges = import_graph(spark, d)
    return an.communities(nodes.where("type = 'file'"), gb.adjacency(edges)).select("id", "community")


@register(f"""with recursive {NODES_SQL}, {CONTAINS_SQL}, adjacent as (select source as src, target as dst from contained union select target, source from contained union select id, id from nodes),
 lab as (select 0 as k, id, ord as label from nodes
  union all select k + 1, src, label from (select k, src, label, row_number() over (partition by k, src order by votes desc, label) as rn from (select lab.k, a.src, lab.label, count(*) as votes from adjacent a join lab on lab.id = a.dst where lab.k < 4 group by all)) where rn = 1)
select id, label as community from lab where k = 4""")
def communities_parallel(spark, d):
    nodes = star.star_nodes(spark, d)
    return an.communities_parallel(nodes, gb.adjacency(star.contains_edges(spark, d)), rounds=4).select("id", "community")


def partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers with a fixed partition (regions; customers by market segment) and centrality."""
    c = star.table(spark, d, "customer").select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("cid"), F.ascii("c_mktsegment").alias("seg"), F.round(F.col("c_acctbal") / 10000, 3).alias("cen"))
    nodes = star.star_nodes(spark, d, ("region", "nation", "customer")).drop("community", "centrality").join(c, F.col("id") == F.col("cid"), "left")
    region = F.when(F.col("type") == "region", F.regexp_extract("id", r"(\d+)", 1).cast("int")).when(F.col("type") == "nation", F.regexp_extract("source_file", r"(\d+)", 1).cast("int"))
    return nodes.withColumn("community", F.coalesce("seg", region)).withColumn("centrality", F.col("cen")).drop("cid", "seg", "cen")


_PARTITION_SQL = f"""{NODES_SQL}, {CONTAINS_SQL}, p as (select ord, id, label, case type when 'region' then split_part(id, '_', 2)::int when 'nation' then split_part(source_file, '_', 2)::int else ascii(c_mktsegment) end as community, round(c_acctbal / 10000, 3) as centrality
 from nodes left join customer on type = 'customer' and id = 'customer_' || c_custkey where type in ('region', 'nation', 'customer')),
 best as (select community, label from p qualify row_number() over (partition by community order by coalesce(centrality, 0) desc, ord) = 1)"""


@register(f"""with {_PARTITION_SQL} select e.ord, s.label as source, t.label as target, relation, 'Cross-community bridge between "' || bs.label || '" and "' || bt.label || '"' as reason
 from contained e join p s on s.id = e.source join p t on t.id = e.target join best bs on bs.community = s.community join best bt on bt.community = t.community where s.community <> t.community""")
def surprises(spark, d):
    return an.surprises(partitioned(spark, d), star.contains_edges(spark, d))


@register(f"""with {_PARTITION_SQL}, r as (select *, row_number() over (partition by community order by ord) as rn from p)
select community, count(*) as size, string_agg(label, ', ' order by rn) filter (rn <= 3) as members, coalesce(arg_max(label, ord) filter (coalesce(centrality, 0) > 0), arg_min(label, ord)) as label from r group by 1""")
def community_members(spark, d):
    return an.community_overview(partitioned(spark, d)).select("community", "size", F.array_join("members", ", ").alias("members"), "label")


@register(f"with {_PARTITION_SQL} select community, label as best_label from best")
def community_best(spark, d):
    return an.community_best(partitioned(spark, d)).select("community", "best_label")


# ---- text and retrieval

@register(f"with t as (select doc_id, {TOKENS_SQL.format('text')} as k from documents) select doc_id, len(k)::int as n_tokens, sha256(array_to_string(k, ' ')) as joined from t")
def tokenize_documents(spark, d):
    k = tokenize(F.col("text"))
    return star.table(spark, d, "documents").select("doc_id", k.alias("k")).select("doc_id", F.size("k").alias("n_tokens"), F.sha2(F.concat_ws(" ", "k"), 256).alias("joined"))


_INDEX_SQL = f"""t as (select doc_id as ord, {TOKENS_SQL.format("substr(text, 1, 80) || ' ' || text || ' ' || lang")} as k from documents), docs as (select * from t where len(k) > 0),
 tf as (select ord, term, count(*) as tf from (select ord, unnest(k) as term from docs) group by all), df as (select term, count(*) as df from tf group by 1),
 idf as (select term, df, ln(((select count(*) from docs) + 1) / (df + 1)) + 1 as idf from df), norms as (select ord, sqrt(sum((tf * idf) ** 2)) as norm from tf join idf using (term) group by 1)"""


@register(f"with {_INDEX_SQL} select term, df from df")
def doc_freq(spark, d):
    return rt.TextIndex.build(star.document_nodes(spark, d)).idf.select("term", "df")


@register(f"with {_INDEX_SQL} select term, round(idf, 8) as idf from idf")
def idf(spark, d):
    return rt.TextIndex.build(star.document_nodes(spark, d)).idf.select("term", F.round("idf", 8).alias("idf"))


def _scores_sql(question: str) -> str:
    asked = rt.tokens_of(question)
    q = ", ".join(f"({i}, '{t}')" for i, t in enumerate(asked))
    return f"""q(i, term) as (values {q}), qn as (select sqrt(sum(coalesce(idf, 0.5) ** 2)) as qn from q left join idf using (term)),
 dot as (select ord, sum(tf * idf * idf) as dot from tf join idf using (term) where term in (select term from q) group by 1),
 bonus as (select ord, sum(0.3) as bonus from docs, q where contains(array_to_string(k, ' '), q.term) group by 1),
 scores as (select docs.ord, least(1.0, coalesce(dot / (qn * norm), 0) + coalesce(bonus, 0))::double as score from docs cross join qn left join dot using (ord) left join norms using (ord) left join bonus using (ord))"""


DOCUMENT_QUESTION = "the license of the Work, and the MITLicense version"


@register(f"with {_INDEX_SQL}, {_scores_sql(DOCUMENT_QUESTION)} select ord as doc_id, round(score, 6) as score from scores where score >= 0.15")
def tfidf_score(spark, d):
    s = rt.TextIndex.build(star.document_nodes(spark, d)).scores(DOCUMENT_QUESTION)
    return s.where(F.col("score") >= rt.MIN_SCORE).select(F.col("ord").alias("doc_id"), F.round("score", 6).alias("score"))


_COST_SQL = "ceil(octet_length(encode({0})) / 4)"


@register("""with c as (select conv_id, turn, ceil(length(text) / 4)::int as cost from conversations), s as (select *, sum(cost) over (partition by conv_id order by turn) as used from c)
select conv_id, turn, cost, used::bigint as used from s where used <= 600""")
def budget_prefix(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = star.table(spark, d, "conversations").select("conv_id", "turn", token_cost(F.col("text")).alias("cost"))
    return c.withColumn("used", F.sum("cost").over(w)).where("used <= 600")


@register("""with c as (select conv_id, list({'turn': turn, 'cost': ceil(length(text) / 4)} order by turn) as items from conversations group by 1),
 f as (select conv_id, list_reduce(list_prepend({'used': 0.0::double, 'taken': []::bigint[], 'turn': -1::bigint, 'cost': 0.0::double}, list_transform(items, lambda x: {'used': 0.0::double, 'taken': []::bigint[], 'turn': x.turn::bigint, 'cost': x.cost::double})),
   lambda s, x: {'used': case when s.used >= 450 or s.used + x.cost > 475 then s.used else s.used + x.cost end, 'taken': case when s.used >= 450 or s.used + x.cost > 475 then s.taken else list_append(s.taken, x.turn) end, 'turn': x.turn, 'cost': x.cost}) as r from c)
select conv_id, r.used as used, array_to_string(r.taken, ',') as taken from f""")
def budget_pack(spark, d):
    c = star.table(spark, d, "conversations").select("conv_id", F.struct("turn", F.col("turn").alias("key"), token_cost(F.col("text")).alias("cost")).alias("x"))
    items = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("items"))  # a conversation's turns
    folded = items.withColumn("s", F.expr(rt.pack_expression("items", "0", "500", "bigint")))
    return folded.select("conv_id", "s.used", F.array_join(F.col("s.taken").cast("array<string>"), ",").alias("taken"))


_RANKED_SQL = f"""{GRAPH_SQL}, t as (select ord, {TOKENS_SQL.format("label || '  ' || type")} as k from nodes), docs as (select * from t where len(k) > 0),
 tf as (select ord, term, count(*) as tf from (select ord, unnest(k) as term from docs) group by all), df as (select term, count(*) as df from tf group by 1),
 idf as (select term, df, ln(((select count(*) from docs) + 1) / (df + 1)) + 1 as idf from df), norms as (select ord, sqrt(sum((tf * idf) ** 2)) as norm from tf join idf using (term) group by 1), {_scores_sql(QUESTION)},
 ranked as (select n.id, n.ord, score from scores join nodes n using (ord) where score >= 0.15)"""
_NODE_COST_SQL = "ceil((length('### ' || label || ' (' || type || ')' || chr(10) || '→ File: ' || source_file) + 2) / 4)::double"
_QUERY_SQL = f"""{_RANKED_SQL},
 offers as (select id, -score as k1, ord as k2, 0 as k3, 0::bigint as k4 from ranked union all select r2.id, -r.score, r.ord, 1, nbr_ord from ranked r join adj on r.id = src join ranked r2 on r2.id = dst where r2.score >= 0.075),
 place as (select id, min({{'k1': k1, 'k2': k2, 'k3': k3, 'k4': k4}}) as p from offers group by 1),
 seq as (select list({{'used': 0.0::double, 'taken': []::varchar[], 'id': id, 'cost': ceil((length('### ' || label || ' (' || type || ')' || chr(10) || '→ File: ' || source_file) + 2) / 4)::double}} order by p) as items from place join nodes using (id)),
 fold as (select list_reduce(list_prepend({{'used': {rt.header_cost(QUESTION, ASK_BUDGET)}.0::double, 'taken': []::varchar[], 'id': '', 'cost': 0.0::double}}, items),
   lambda s, x: {{'used': case when s.used >= {ASK_BUDGET * 0.9} or s.used + x.cost > {ASK_BUDGET * 0.95} then s.used else s.used + x.cost end, 'taken': case when s.used >= {ASK_BUDGET * 0.9} or s.used + x.cost > {ASK_BUDGET * 0.95} then s.taken else list_append(s.taken, x.id) end, 'id': '', 'cost': 0.0::double}}) as r from seq),
 chosen as (select unnest(r.taken) as id, unnest(range(len(r.taken))) as pos, r.used as used from fold)"""


def _asked(spark: SparkSession, d: str) -> rt.Result:
    nodes, edges, adj = graph(spark, d)
    return rt.query(nodes, edges, adj, QUESTION, ASK_BUDGET)


@register(f"with {_QUERY_SQL} select pos::int as pos, id, used::int as used from chosen")
def query_bfs_nodes(spark, d):
    r = _asked(spark, d)
    return r.nodes.select("pos", "id", F.lit(r.tokens_used).alias("used"))


@register(f"""with {_QUERY_SQL} select source, target, relation from (select *, row_number() over (partition by least(source, target), greatest(source, target) order by ord) as rn from edges where source in (select id from chosen) and target in (select id from chosen)) where rn = 1""")
def query_bfs_edges(spark, d):
    return _asked(spark, d).edges.select("source", "target", "relation")


#: The walk as a stack machine: a row a step; a popped node is passed over if it was visited, lies too deep, or the budget is met.
_DFS_SQL = f"""with recursive {_RANKED_SQL}, costs as (select id, {_NODE_COST_SQL} as cost from nodes),
 near as (select src, list(dst order by coalesce(score, 0) desc, nbr_ord) as best from adj left join ranked on id = dst group by 1),
 walk as (select 0 as step, [id] as ids, [0] as depths, []::varchar[] as seen, []::varchar[] as chosen, {rt.header_cost(QUESTION, ASK_BUDGET)}.0::double as used from (from ranked order by score desc, ord limit 1)
  union all select step + 1, case when go then list_concat(rest, list_reverse(fan)) else rest end, case when go then list_concat(below, list_transform(fan, lambda x: depth + 1)) else below end,
   case when go then list_append(seen, top) else seen end, case when go and used + cost <= {ASK_BUDGET * 0.95} then list_append(chosen, top) else chosen end, case when go and used + cost <= {ASK_BUDGET * 0.95} then used + cost else used end
  from (select *, list_filter(coalesce(best, []), lambda x: x <> top and not list_contains(seen, x))[1:3] as fan, depth <= 5 and used < {ASK_BUDGET * 0.9} and not list_contains(seen, top) as go
   from (select step, seen, chosen, used, ids[1:len(ids) - 1] as rest, depths[1:len(ids) - 1] as below, ids[len(ids)] as top, depths[len(ids)] as depth from walk where len(ids) > 0)
   join costs on costs.id = top left join near on src = top)),
 last as (select chosen, used from walk where len(ids) = 0)
select unnest(range(len(chosen)))::int as pos, unnest(chosen) as id, used::int as used from last"""


@register(_DFS_SQL)
def query_dfs(spark, d):
    nodes, edges, adj = graph(spark, d)
    r = rt.query(nodes, edges, adj, QUESTION, ASK_BUDGET, mode="dfs")
    return r.nodes.select("pos", "id", F.lit(r.tokens_used).alias("used"))


@register(f"with {NODES_SQL} select id, ceil((length('### ' || label || ' (' || type || ')' || chr(10) || '→ File: ' || source_file) + 2) / 4)::int as cost from nodes")
def node_costs(spark, d):
    return star.star_nodes(spark, d).select("id", node_cost().alias("cost"))


@register(f"with {NODES_SQL} select id from nodes where contains(lower(label), 'r#00000000') or contains(lower(id), 'r#00000000')")
def entity_matches(spark, d):
    return rt.matches(star.star_nodes(spark, d), "R#00000000").select("id")


@register(f"""with {NODES_SQL}, {EDGES_SQL}, x as (select e.ord, relation, confidence, case when source = 'nation_7' then '→' else '←' end as direction, n.label as other, n.type,
 count(*) over (partition by relation) as total, row_number() over (partition by relation order by e.ord) as rn from edges e join nodes n on n.id = case when source = 'nation_7' then target else source end where source = 'nation_7' or target = 'nation_7')
select relation, total, rn, direction, other, type, confidence from x where rn <= 15""")
def explain_entity(spark, d):
    nodes, edges, _ = graph(spark, d)
    return rt.relationships(nodes, edges, "nation_7").select("relation", "total", "rn", "direction", "other", "type", "confidence")


# ---- sources, scalars, views

@register("select key as field, count(*) as n from (select unnest(json_keys(props)) as key from events) group by 1")
def json_fields(spark, d):
    keys = star.table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("field"))
    return keys.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@register("""select page_id, i::int as pos, l as link from (select page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) as l, unnest(range(len(regexp_extract_all(html, 'href="/([^"]*)"', 1)))) as i from pages)""")
def link_extract(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)
    return star.table(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "link"))


@register("""with v as (select distinct unnest(string_split(text, ' ')) as w from documents),
 l as (select distinct unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) as link from pages),
 c as (select link, 0 as r, link as w from l union all select link, 1, regexp_replace(link, '[.,]+$', '') from l union all select link, 2, lower(regexp_replace(link, '[.,]+$', '')) from l)
select link, arg_min(w, r) as target from c join v using (w) group by 1""")
def link_resolve(spark, d):
    from ..extract.run import resolve_links

    links = star.table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("key")).distinct()
    bare = F.regexp_replace("key", "[.,]+$", "")
    ranked = links.select("key", F.array(F.col("key"), bare, F.lower(bare)).alias("candidates"))
    words = star.table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("path")).distinct()
    return resolve_links(ranked, words).select(F.col("key").alias("link"), F.col("path").alias("target"))


@register(r"select regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '(\.[^./\\]*)$', 1) as ext, count(*) as n from pages group by 1")
def ext_histogram(spark, d):
    clean = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return by_extension(star.table(spark, d, "pages").select(extension(clean).alias("ext")))


@register("select count(*) filter (o_orderdate > timestamp '1998-01-01') > 0 as stale, count(*) filter (o_orderdate > timestamp '1998-01-01') as count from (select * from orders order by o_orderkey limit 200)")
def stale_files(spark, d):
    files = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).alias("mtime"))
    return staleness(files, 883612800000.0)


@register("""with h as (select doc_id, source, substr(sha256(text), 1, 16) as hash from documents), cache as (select distinct source as file, hash from h where doc_id < 500)
select doc_id, h.hash, cache.hash is not null as cached from h left join cache on cache.file = h.source and cache.hash = h.hash""")
def hash_cache(spark, d):
    h = star.table(spark, d, "documents").select("doc_id", "source", content_hash(F.col("text")).alias("hash"))
    cache = h.where("doc_id < 500").select("source", "hash").distinct()
    hit = h.join(cache, ["source", "hash"], "left_semi").select("doc_id", "hash", F.lit(True).alias("cached"))
    return hit.unionByName(h.join(cache, ["source", "hash"], "left_anti").select("doc_id", "hash", F.lit(False).alias("cached")))


@register(r"select page_id, regexp_replace(regexp_replace(url, '[\\/]', '_', 'g'), '\.[^.]+$', '') || '_' || regexp_replace(substr(html, 1, 60), '[^a-zA-Z0-9_$]', '_', 'g') as node_id from pages")
def node_ids(spark, d):
    return star.table(spark, d, "pages").select("page_id", node_id(F.col("url"), F.substring("html", 1, 60)).alias("node_id"))


@register(r"select doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 200) as description, ceil(length(text) / 4)::int as cost from documents")
def descriptions(spark, d):
    return star.table(spark, d, "documents").select("doc_id", one_line(F.col("text")).alias("description"), token_cost(F.col("text")).alias("cost"))


_VIZ_SQL = f"""{GRAPH_SQL}, dg as (select src, count(*) as degree from adj group by 1), top as (select ord, id, label, coalesce(degree, 0) as degree, case type when 'nation' then split_part(source_file, '_', 2)::int else 0 end as community
 from nodes left join dg on src = id order by degree desc nulls last, ord limit 1500)"""


def _viz(spark: SparkSession, d: str) -> DataFrame:
    nodes, adj = numbered(spark, d)
    owner = F.regexp_extract("source_file", r"(\d+)$", 1).cast("int")
    return viz_nodes(nodes.withColumn("community", F.when(F.col("type") == "nation", owner)), adj)


@register(f"with {_VIZ_SQL} select id, degree, community % 25 as colour, round(greatest(5, least(25, log2(degree + 2) * 8)), 6)::double as size from top")
def viz_top_nodes(spark, d):
    return _viz(spark, d).select("id", "degree", "colour", F.round("size", 6).alias("size"))


@register(f"with {_VIZ_SQL} select community, count(*) as n, arg_max(label, degree * 10000000000000 - ord) as label from top group by 1")
def viz_communities(spark, d):
    return viz_legend(_viz(spark, d))


@register("select 'customer_' || c_custkey as id, 0 as degree from customer order by c_custkey limit 1500")
def viz_without_files(spark, d):
    nodes, edges = import_graph(spark, d)
    return viz_nodes(nodes, gb.adjacency(edges)).select("id", F.col("degree").cast("int").alias("degree"))


@register(f"with {_VIZ_SQL} select source, target, confidence <> 'EXTRACTED' as dashed from edges where source in (select id from top) and target in (select id from top) order by ord limit 4000")
def viz_links(spark, d):
    shown, edges = _viz(spark, d), star.star_edges(spark, d)
    return viz_edges(shown, edges).select("source", "target", (F.col("confidence") != "EXTRACTED").alias("dashed"))


@register(f"with {GRAPH_SQL}, dg as (select src, count(*) as degree from adj group by 1) select label, type, degree, source_file from nodes join dg on src = id order by degree desc, ord limit 5")
def most_connected(spark, d):
    nodes, adj = numbered(spark, d)
    return connected_table(nodes, adj).select("label", "type", "degree", "source_file")


@register(f"with {_PARTITION_SQL} select e.ord, s.label as source, t.label as target from contained e join p s on s.id = e.source join p t on t.id = e.target where s.community <> t.community order by e.ord limit 10")
def first_bridges(spark, d):
    return an.surprises(partitioned(spark, d), star.contains_edges(spark, d)).orderBy("ord").limit(10).select("ord", "source", "target")


@register(f"with {_PARTITION_SQL} select community, count(*) as size from p group by 1 order by size desc, min(ord) limit 3")
def largest_communities(spark, d):
    return an.community_overview(partitioned(spark, d)).orderBy(F.desc("size"), "first_ord").limit(3).select("community", "size")


@register(f"with {NODES_SQL} select id from nodes where contains(lower(label), 'er#') or contains(lower(id), 'er#') order by ord limit 1")
def first_match(spark, d):
    return rt.matches(star.star_nodes(spark, d), "ER#").orderBy("ord").limit(1).select("id")


@register(f"with {_QUERY_SQL} select '{QUESTION}' as question, 'bfs' as mode, max(used)::int as tokens_used, {ASK_BUDGET} as budget, count(*) / (select count(*) from nodes)::double as coverage from chosen")
def query_summary(spark, d):
    return _asked(spark, d).summary()


@register("with t as (select page_id, substr(html, 1, 300) as h from pages) select page_id, replace(replace(replace(replace(replace(h, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;') as safe from t")
def escaped_pages(spark, d):
    return star.table(spark, d, "pages").select("page_id", escape_html(F.substring("html", 1, 300)).alias("safe"))


@register(f"with {NODES_SQL} select type, upper(substr(type, 1, 1)) || substr(type, 2) || 's' as title, count(*) as n, min(ord) as first_ord from nodes group by 1")
def nodes_by_type(spark, d):
    return star.star_nodes(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord")).select("type", plural_title(F.col("type")).alias("title"), "n", "first_ord")


@register(r"""with n as (select doc_id, substr(text, 1, 80) as label, lang as type, source as source_file, case when doc_id % 3 > 0 then 'L' || doc_id end as loc, case when doc_id % 2 = 1 then substr(text, 1, 120) end as descr, doc_id % 1000 / 1000 as cen from documents where text is not null),
 t as (select *, '### ' || label || ' (' || type || ')' || case when loc is null then '' else ' · score: ' || printf('%.2f', cen + case when doc_id % 1000 in (125, 625) then 0.001 else 0 end) end as head, chr(10) || '→ File: ' || source_file || coalesce(' ' || loc, '') as tail from n)
select doc_id, head || tail as short, ceil((length(head || case when coalesce(descr, '') = '' then '' else chr(10) || descr end || tail || chr(10) || chr(10))
 + length(regexp_replace(label || coalesce(descr, ''), '[\x{0}-\x{FFFF}]', '', 'g'))) / 4)::int as cost from t""")
def node_displays(spark, d):
    n = star.document_nodes(spark, d).where("description is not null")
    n = n.withColumn("source_location", F.when(F.col("ord") % 3 > 0, F.concat(F.lit("L"), F.col("ord").cast("string")))).withColumn("description", F.when(F.col("ord") % 2 == 1, F.substring("description", 1, 120))).withColumn("centrality", F.col("ord") % 1000 / 1000)
    return n.select(F.col("ord").alias("doc_id"), node_display(False).alias("short"), node_cost().alias("cost"))


@register("""with n as (select doc_id, doc_id % 31 as k from documents), f as (select doc_id, unnest(range(1, k + 1)) as i from n)
select 'd' || doc_id || '_k' || i as id, 'k' || i as label from f where i <= 20""")
def json_keys_first_20(spark, d):
    from ..extract.run import extract_table

    every = F.expr("transform(sequence(0, cast(doc_id % 31 as int)), i -> concat('k', i))")
    keys = F.slice(every, F.lit(2), F.size(every))
    docs = star.table(spark, d, "documents").select("doc_id", F.to_json(F.map_from_arrays(keys, keys)).alias("content"))
    contents = docs.select(F.col("doc_id").cast("int").alias("ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), F.lit("").alias("hash"), "content")
    return extract_table(contents).where("kind = 'node' and type = 'field'").select("id", "label")


SAMPLE = [
    ("src/auth.ts", "export function login(u: string) {\n  return check(u) && verify(u);\n}\n\nfunction check(u: string) {\n  return !!u;\n}\n\nfunction verify(u: string) { return true; }\n"),
    ("src/controller.ts", "import { login } from './auth';\n\nexport class Controller {\n  run(u: string) {\n    return login(u);\n  }\n}\n"),
    ("pkg/tool.py", 'import os\n\ndef walk(p):\n    """Walk a tree."""\n    return os.listdir(clean(p))\n\ndef clean(p):\n    return p\n'),
    ("run.sh", "function setup() {\n :\n}\nmain () { setup; }\n"),
    ("conf.json", '{"name": "x", "10": 1, "2": 2}'),
]


@register("""select * from (values ('src_auth_login', 'function', 'L1'), ('src_auth_check', 'function', 'L5'), ('src_auth_verify', 'function', 'L9'), ('src_controller_Controller', 'class', 'L3'), ('src_controller_Controller_run', 'method', 'L4'),
 ('pkg_tool_walk', 'function', 'L3'), ('pkg_tool_clean', 'function', 'L7'), ('run_setup', 'function', 'L1'), ('run_main', 'function', 'L4'), ('conf_2', 'field', null), ('conf_10', 'field', null), ('conf_name', 'field', null)) t(id, type, location)""")
def extract_sample(spark, d):
    from ..extract.run import extract_table

    contents = spark.createDataFrame([(i, p, "", c) for i, (p, c) in enumerate(SAMPLE)], "ord int, path string, hash string, content string")
    return extract_table(contents, {p for p, _ in SAMPLE}).where("kind = 'node' and type <> 'file'").select("id", "type", "location")


@register("""select * from (values ('src_auth_login', 'src_auth_check', 'calls'), ('src_auth_login', 'src_auth_verify', 'calls'), ('src_controller_file', 'src_auth_file', 'imports'),
 ('pkg_tool_walk', 'pkg_tool_os_listdir', 'calls'), ('pkg_tool_walk', 'pkg_tool_clean', 'calls'), ('pkg_tool_file', 'pkg_tool_os', 'imports')) t(source, target, relation)""")
def extract_sample_edges(spark, d):
    from ..extract.run import extract_table

    contents = spark.createDataFrame([(i, p, "." + p.rsplit(".", 1)[1], "", c) for i, (p, c) in enumerate(SAMPLE)], "ord int, path string, ext string, hash string, content string")
    paths = spark.createDataFrame([(p,) for p, _ in SAMPLE], "path string")
    return extract_table(contents, paths).where("kind = 'edge' and relation <> 'contains'").select("source", "target", "relation")
