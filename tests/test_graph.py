"""The small graphs of the test plan, with hand-derived values, and the semantics of order."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import analytics as an
from graphloom.operators import build as gb
from graphloom.operators import retrieve as rt
from graphloom.report import connected_table, html_page, report, repository_map, suggested_questions
from graphloom.schema import EDGES, NODES


def make(spark, nodes, edges):
    n = spark.createDataFrame([(i, v, *rest) for i, (v, *rest) in enumerate(nodes)], NODES)
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(edges)], EDGES)
    return n, e


def node(v, label=None, kind="function", file="src/x.ts", loc="L1", desc=None, com=None, cen=None):
    return (v, label or v, kind, file, loc, desc, com, cen)


def edge(a, b, rel="calls", conf="INFERRED", score=None):
    return (a, b, rel, conf, score)


FIVE = ([node("f1", "src/a.ts", "file", "src/a.ts", None), node("a"), node("b"), node("f2", "src/b.ts", "file", "src/b.ts", None), node("c")],
        [edge("f1", "a", "contains", "EXTRACTED"), edge("f1", "b", "contains", "EXTRACTED"), edge("a", "b", score=0.85), edge("f2", "c", "contains", "EXTRACTED"), edge("c", "a", score=0.95)])


@pytest.fixture(scope="module")
def five(spark):
    return gb.build(*make(spark, *FIVE))


def in_order(df, column):
    return [r[column] for r in df.orderBy("ord").collect()]


def test_build_drops_dangling_and_last_node_wins(spark):
    n, e = gb.build(*make(spark, [*FIVE[0], node("a", "renamed")], [*FIVE[1], edge("ghost", "a")]))
    assert n.count() == 5 and e.count() == 5
    assert n.where("id = 'a'").first()["label"] == "renamed" and n.where("id = 'a'").first()["ord"] == 1


def test_centrality_goldens(five):
    n, e = five
    assert in_order(an.centrality(n, gb.adjacency(e)), "centrality") == [0.192, 0.283, 0.192, 0.12, 0.213]


def test_joined_pagerank_equals_grouped(five):
    n, e = five
    adj = gb.adjacency(e).select("src", "dst")
    a = {r["id"]: r["rank"] for r in an.pagerank(n.select("id"), adj).collect()}
    b = {r["id"]: r["rank"] for r in an.pagerank(n.select("id"), adj, local_rows=0).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert sum(a.values()) == pytest.approx(1)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_pagerank_moves_vectors(spark, monkeypatch, kind):
    """On many blocks: a hub, nodes without links, links that leave the nodes; a step returns a row a bucket, not a row a node or link."""
    from graphloom.operators import blocks

    monkeypatch.setattr(blocks, "partitions_for", lambda *_: 50)
    rnd, nodes = random.Random(7), range(60)
    links = {(a, b) for a in nodes for b in (0, *rnd.sample(range(70), 4)) if a != b and a % 10} | {(0, b) for b in range(1, 60)}
    ids, pairs = spark.createDataFrame([(v,) for v in nodes], "id long"), spark.createDataFrame(sorted(links), "src long, dst long")
    ids, pairs = ids.select(F.col("id").cast(kind)), pairs.select(F.col("src").cast(kind), F.col("dst").cast(kind))
    grid = blocks.Grid(ids, pairs, 0.85)
    assert grid.step(grid.start()).count() == grid.nodes.count() == 5 and grid.blocks.count() == 25
    grid.close()
    out = {v: sum(a == v for a, _ in links) for v in nodes}
    rank = dict.fromkeys(nodes, 1 / 60)
    for _ in range(3):
        rank = {v: 0.15 / 60 + sum(0.85 * rank[a] / out[a] for a, b in links if b == v) for v in nodes}
    got = {int(r["id"]): r["rank"] for r in an.pagerank_iterations(ids, pairs, 3).collect()}
    assert got == pytest.approx(rank, abs=1e-12)
    none = an.pagerank_iterations(ids.where("false"), pairs.where("false"), 2)
    assert none.dtypes == [("id", "string" if kind == "string" else "bigint"), ("rank", "double")] and none.count() == 0


def test_isolated_nodes_leak(spark):
    n, e = make(spark, [node("a"), node("b"), node("c")], [edge("a", "b")])
    assert in_order(an.centrality(n, gb.adjacency(e)), "centrality") == [0.333, 0.333, 0.05]


def test_communities_goldens(five, spark):
    n, e = five
    assert in_order(an.communities(n, gb.adjacency(e)), "community") == [2, 1, 2, 2, 1]
    t, te = make(spark, [node("A"), node("B"), node("C")], [edge("A", "B"), edge("B", "C"), edge("A", "C")])
    assert in_order(an.communities(t, gb.adjacency(te)), "community") == [2, 1, 2]
    assert in_order(an.communities(t, gb.adjacency(te.limit(0))), "community") == [None] * 3


def test_communities_against_a_plain_loop(spark):
    rng = random.Random(4)
    nodes, edges = [node(f"v{i}") for i in range(30)], [edge(f"v{rng.randrange(30)}", f"v{rng.randrange(30)}") for _ in range(60)]
    n, e = make(spark, nodes, edges)
    near = {v[0]: {} for v in nodes}
    for a, b, *_ in edges:
        near[a].setdefault(b)
        near[b].setdefault(a)
    label = {v[0]: i for i, v in enumerate(nodes)}
    for _ in range(50):
        moved = False
        for v in near:
            seen = [label[u] for u in near[v]]
            best, top = label[v], 0
            for c in dict.fromkeys(seen):
                if c != label[v] and seen.count(c) > top:
                    best, top = c, seen.count(c)
            moved |= best != label[v]
            label[v] = best
        if not moved:
            break
    assert {r["id"]: r["community"] for r in an.communities(n, gb.adjacency(e)).collect()} == label


def plain_labels(near, sweeps):
    label = list(range(len(near)))
    for _ in range(sweeps):
        moved = False
        for v, us in enumerate(near):
            seen = [label[u] for u in us]
            best, top = label[v], 0
            for c in dict.fromkeys(seen):
                if c != label[v] and seen.count(c) > top:
                    best, top = c, seen.count(c)
            moved |= best != label[v]
            label[v] = best
        if not moved:
            break
    return label


@pytest.mark.parametrize("sweeps", [1, 2, 7, 50])
def test_labels_by_blocks_equal_a_plain_loop(sweeps):
    import numpy as np

    from graphloom.operators.propagation import Block, settle

    for seed in range(30):
        rng = random.Random(seed)
        n = rng.choice([2, 9, 40, 300])
        sides = rng.random() < 0.5  # two sides without links within: many vote at once
        near = [[] for _ in range(n)]
        for _ in range(rng.choice([n // 2, 2 * n, 8 * n])):
            a, b = (rng.randrange(n // 2), rng.randrange(n // 2, n)) if sides else (rng.randrange(n), rng.randrange(n))
            near[a] += [] if b in near[a] else [b]
            near[b] += [] if a in near[b] else [a]
        size = rng.choice([1, 7, n])
        groups = [[v for v in range(k, min(k + size, n)) if near[v]] for k in range(0, n, size)]
        blocks = [Block(*(np.array(x, dtype=np.int32) for x in (g, [len(near[v]) for v in g], [u for v in g for u in near[v]]))) for g in groups if g]
        rng.shuffle(blocks)
        assert settle(n, blocks, sweeps).tolist() == plain_labels(near, sweeps), seed


def test_communities_have_no_limit_of_rows_and_cut_blocks_at_nodes(spark):
    """They refused graphs beyond a number of rows; blocks smaller than a node's neighbours must not part them."""
    from graphloom.operators.propagation import propagated

    rng = random.Random(8)
    n, links = 60, {(rng.choice([0, rng.randrange(60)]), rng.randrange(60)) for _ in range(150)}
    near = [[] for _ in range(n)]
    for a, b in sorted(links):
        near[a] += [] if b in near[a] else [b]
        near[b] += [] if a in near[b] else [a]
    ords = [7 * (v // 10) * 10 + v for v in range(n)]  # with gaps
    nodes = spark.createDataFrame([(o,) for o in ords], "ord long")
    adj = spark.createDataFrame([(ords[v], ords[u], k) for v in range(n) for k, u in enumerate(near[v])], "src long, dst long, nbr_ord long").repartition(3)
    assert not hasattr(an, "EXACT_ROWS")
    for block_rows in (1, 16, 1 << 20):
        assert [r["community"] for r in propagated(nodes, adj, 50, block_rows).orderBy("ord").collect()] == plain_labels(near, 50)


def test_adjacency_with_null_ends_loops_and_numbers(spark):
    rows = [(0, 1, 2), (1, 2, 1), (2, None, 1), (3, 1, None), (4, 3, 3), (5, None, None), (6, 3, 3)]
    e = spark.createDataFrame(rows, "ord long, source long, target long")
    want = {}
    for o, a, b in rows:
        for k, pair in enumerate(((a, b), (b, a))):
            want[pair] = min(want.get(pair, 99), 2 * o + k)
    assert sorted((r["src"] or 0, r["dst"] or 0, r["nbr_ord"]) for r in gb.adjacency(e).collect()) == sorted((a or 0, b or 0, o) for (a, b), o in want.items())


def test_partitions_grow_with_the_input(spark, tmp_path, monkeypatch):
    spark.range(10_000).selectExpr("id as ord", "id % 97 as source", "id % 89 as target").write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    assert gb.partitions_for(e) == 4 and gb.adjacency(e).count() == len({x for i in range(10_000) for x in ((i % 97, i % 89), (i % 89, i % 97))})
    monkeypatch.setattr(gb, "PARTITION_BYTES", 1000)
    assert gb.partitions_for(e) > 20 and gb.adjacency(e).rdd.getNumPartitions() == gb.partitions_for(e)


def test_large_tables_are_dealt_whatever_the_session_has(spark, tmp_path, monkeypatch):
    """With more partitions in the session than needed, rows were gathered where they are read and partitions merged; of the two orders of a pair one travels."""
    spark.range(10_000).selectExpr("id as ord", "id % 97 as source", "id % 89 as target").write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    want = {}
    for i in range(10_000):
        for pair, o in (((i % 97, i % 89), 2 * i), ((i % 89, i % 97), 2 * i + 1)):
            want[pair] = min(want.get(pair, o), o)
    monkeypatch.setattr(gb, "LEFT_BYTES", 1000)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        adj = gb.adjacency(e)
        plan = adj._jdf.queryExecution().executedPlan().toString()  # as planned, before it runs
        assert plan.count("hashpartitioning(") == 1 and "REPARTITION_BY_NUM" in plan and "ba#" not in plan[plan.index("REPARTITION_BY_NUM") :]
        assert gb.partitions_for(e) == 64 and adj.rdd.getNumPartitions() == 64
        assert {(r["src"], r["dst"]): r["nbr_ord"] for r in adj.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_degrees_are_counted_by_numbers(spark, tmp_path):
    """Ids are not shuffled; keys may be negative, null, repeated, or as large as the step between the tables' ord."""
    from graphloom.plans import catalog

    far = 2 * 10**12  # a customer with the ord of part 0
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R")]), "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0), (1, "M", 0)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int", [(-3, "c", 0), (far, "far", 1), (None, "none", 1), (5, "twice", 0), (5, "twice", 0)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(0, "s", 1), (7, "t", None)]), "part": ("p_partkey long, p_name string", [(0, "p"), (1, "alone"), (-3, "q")]),
        "lineitem": ("l_suppkey long, l_partkey long", [(0, 0), (0, 0), (7, 0), (0, -3), (7, None), (9, 0)]),
    }
    for name, (columns, rows) in tables.items():
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    (nodes, _, by_id), (numbered, by_number) = catalog.graph(spark, str(tmp_path)), catalog.numbered(spark, str(tmp_path))
    every = lambda df: sorted((str(r["id"]), r["label"], r["degree"]) for r in df.collect())
    got = an.degrees(numbered, by_number)
    assert every(got) == every(an.degrees(nodes, by_id)) and ("customer_2000000000000", "far", 1) in every(got) and ("part_0", "p", 3) in every(got) and ("None", "none", 0) in every(got)
    for query in (catalog.degree_topk, catalog.most_connected, catalog.viz_communities, catalog.viz_top_nodes, catalog.viz_links):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(src" in plan and "& 7)" not in plan  # no number is written as an id


def test_connected_table_joins_nodes_once(spark):
    """The best nodes were joined with all nodes again, in one task where Spark thought these few; rows of one id were multiplied."""
    n, e = make(spark, [node("a", "first"), node("b", file="src/y.ts"), node("a", "again", "class"), node("c")], [edge("a", "b"), edge("c", "a")])
    table = connected_table(n, gb.adjacency(e), 3)
    assert [(r["ord"], r["id"], r["label"], r["degree"], r["type"], r["source_file"]) for r in table.collect()] == [
        (0, "a", "first", 2, "function", "src/x.ts"), (2, "a", "again", 2, "class", "src/x.ts"), (1, "b", "b", 1, "function", "src/y.ts")]
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_few_chosen_nodes_are_not_dealt(spark, tmp_path, monkeypatch):
    """A limit's rows were dealt to as many partitions as the table needs that they were chosen from, and the edges met them by a shuffle."""
    spark.range(10_000).selectExpr("id as ord", "cast(id as string) as id").write.parquet(str(tmp_path / "n"))
    monkeypatch.setattr(gb, "PARTITION_BYTES", 1000)
    chosen = spark.read.parquet(str(tmp_path / "n")).orderBy("ord").limit(5)
    e = spark.createDataFrame([(k, str(k % 7), str(k % 11)) for k in range(77)], "ord long, source string, target string")
    kept = gb.induced(e, chosen)
    assert "REPARTITION_BY_NUM" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["ord"] for r in kept.collect()) == [k for k in range(77) if k % 7 < 5 and k % 11 < 5]


def test_index_counts_terms_in_their_rows(spark):
    """No row a text and term travels; nodes without tokens don't count as texts; a long text with all query tokens needs no norm."""
    import math

    n = spark.createDataFrame([(0, "a", "red ring red", "t"), (1, "b", "", ""), (2, "c", None, "x y"), (3, "d", "Ring of redWine", "")], "ord long, id string, label string, type string")
    n = n.withColumn("description", F.lit(None).cast("string"))
    index = rt.TextIndex.build(n)
    plan = index.counts._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "ord#" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)
    idf = {t: math.log(3 / (f + 1)) + 1 for t, f in {"red": 2, "ring": 2, "of": 1, "wine": 1}.items()}
    assert {r["term"]: r["idf"] for r in index.idf.collect()} == pytest.approx(idf)
    got = {r["id"]: r["score"] for r in index.scores("wine red").collect()}
    q = math.sqrt(idf["wine"] ** 2 + idf["red"] ** 2)
    a = 2 * idf["red"] ** 2 / (q * math.sqrt(4 * idf["red"] ** 2 + idf["ring"] ** 2)) + 0.3
    d = (idf["red"] ** 2 + idf["wine"] ** 2) / (q * math.sqrt(sum(w * w for w in idf.values()))) + 0.6
    assert got == pytest.approx({"a": min(1, a), "d": min(1, d)})
    assert {r["score"] for r in index.scores("red ring of wine red").where("id = 'd'").collect()} == {1.0}
    index.close()


def test_extracted_rows_are_passed_on_in_parts(spark, monkeypatch):
    from graphloom.extract import run

    contents = spark.createDataFrame([(i, f"d{i}.json", "", '{"a": 1, "b": 2, "c": 3}') for i in range(40)], "ord int, path string, hash string, content string")
    want = sorted(map(repr, run.extract_table(contents).collect()))
    monkeypatch.setattr(run, "RAW_ROWS", 3)
    assert sorted(map(repr, run.extract_table(contents).collect())) == want and len(want) > 200


def test_degrees_selfloops_and_parallel_edges(spark, five):
    n, e = five
    assert in_order(an.degrees(n, gb.adjacency(e)), "degree") == [2, 3, 2, 1, 2]
    n, e = make(spark, [node("a"), node("b")], [edge("a", "a"), edge("a", "b"), edge("b", "a"), edge("a", "b")])
    assert in_order(an.degrees(n, gb.adjacency(e)), "degree") == [2, 1]
    assert an.stats(n, e).first()["edge_count"] == 4 and an.stats(n, e).first()["avg_degree"] == 4.0


def test_merge(spark, five):
    n, e = five
    more_n, more_e = make(spark, [node("d"), node("g"), node("a", "not taken")], [edge("d", "a"), edge("d", "ghost")])
    mn, me = gb.merge(n, e, more_n, more_e)
    assert mn.count() == 7 and me.count() == 6
    assert mn.where("id = 'a'").first()["label"] == "a"
    assert len(set(in_order(mn, "ord"))) == 7
    again = gb.merge(mn, me, mn, me)[1]
    assert again.count() == 12 and gb.merge(mn, me, mn, me, dedup_edges=True)[1].count() == 6


def test_file_ranking_and_symbols(spark):
    nodes = [node(f"f{i}", f"src/{i}.ts", "file", f"src/{i}.ts", None) for i in range(3)] + [node(f"s{i}", file="src/0.ts", cen=i / 10) for i in range(8)]
    edges = [edge("f1", "f0", "imports", "EXTRACTED"), edge("f2", "f0", "imports", "EXTRACTED"), edge("f2", "s1", "imports"), edge("f0", "f0", "imports"), edge("f2", "f1", "imports")]
    n, e = make(spark, nodes, edges)
    got = an.file_ranking(n, e).orderBy(F.desc("exact")).collect()
    assert [r["file"] for r in got] == ["src/0.ts", "src/1.ts", "src/2.ts"]
    assert [x["label"] for x in got[0]["symbols"]] == ["s7", "s6", "s5", "s4", "s3", "s2"]
    assert repository_map(n, e).split("\n")[2].startswith("src/0.ts — s7, s6")
    assert repository_map(n.where("type <> 'file'"), e) == ""


def test_bridges_overview_report(spark):
    nodes = [node("a", com=1, cen=0.1), node("b", com=1, cen=0.4), node("c", com=2, cen=None), node("d", com=2, cen=None), node("e", com=None, cen=0.9)]
    edges = [edge("a", "c", "imports", "EXTRACTED"), edge("b", "d"), edge("a", "b", "contains", "EXTRACTED"), edge("e", "a", "contains", "EXTRACTED")]
    n, e = make(spark, nodes, edges)
    got = an.surprises(n, e).collect()
    assert [(r["source"], r["target"], r["reason"]) for r in got] == [("a", "c", 'Cross-community bridge between "b" and "c"')]
    o = {r["community"]: (r["size"], r["members"], r["label"]) for r in an.community_overview(n).collect()}
    assert o == {1: (2, ["a", "b"], "b"), 2: (2, ["c", "d"], "c")}
    text = report(n, e, gb.adjacency(e), "/x")
    assert "| **b** | 2 | a, b |" in text and "| Nodes | 5 |" in text and "| Average degree | 1.6 |" in text
    assert len(suggested_questions(n, e, gb.adjacency(e))) == 5


def test_html_is_escaped(spark):
    n, e = make(spark, [node("a", '<b>"</script>'), node("b")], [edge("a", "b")])
    page = html_page(n, e, gb.adjacency(e), "T<")
    assert page.count("</script>") == 2 and "<b>" not in page and "T&lt;" in page


# ---- retrieval

SIX = ([node("f1", "src/auth.ts", "file", "src/auth.ts", None), node("u1", "authenticateUser", desc="Authenticates a user by validating credentials"), node("u2", "validateInput", desc="Validates the user input format"),
        node("u3", "hashPassword", desc="Hashes a password"), node("f2", "src/middleware.ts", "file", "src/middleware.ts", None), node("c1", "JWTMiddleware", "class", desc="Middleware that handles JWT authentication")],
       [edge("f1", "u1", "contains", "EXTRACTED"), edge("f1", "u2", "contains", "EXTRACTED"), edge("f1", "u3", "contains", "EXTRACTED"), edge("f2", "c1", "contains", "EXTRACTED"), edge("u1", "u2"), edge("u1", "u3"), edge("c1", "u1"), edge("u2", "u1")])


@pytest.fixture(scope="module")
def six(spark):
    n, e = gb.build(*make(spark, *SIX))
    adj = gb.adjacency(e)
    return an.centrality(n, adj).persist(), e, adj


def brute_query(nodes, edges, question, budget, mode, min_score=0.15):
    """The retrieval semantics on plain lists."""
    import math

    asked = rt.tokens_of(question)
    text = {n["id"]: rt.tokens_of(f"{n['label']} {n['description'] or ''} {n['type']}") for n in nodes}
    text = {k: v for k, v in text.items() if v}
    df = {}
    for v in text.values():
        for t in set(v):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((len(text) + 1) / (f + 1)) + 1 for t, f in df.items()}

    def score(v):
        if v not in text or not asked:
            return 0
        q = math.sqrt(sum(idf.get(t, 0.5) ** 2 for t in asked))
        w = {t: text[v].count(t) * idf[t] for t in text[v]}
        dot = sum(idf[t] * w[t] for t in set(asked) if t in w)
        return min(1, dot / (q * math.sqrt(sum(x * x for x in w.values()))) + sum(0.3 for t in asked if t in " ".join(text[v])))

    near = {n["id"]: {} for n in nodes}
    for e in edges:
        near[e["source"]].setdefault(e["target"])
        near[e["target"]].setdefault(e["source"])
    scores = {n["id"]: s for n in nodes if (s := score(n["id"])) >= min_score}
    by_id = {n["id"]: n for n in nodes}

    def cost(v):
        n = by_id[v]
        t = f"### {n['label']} ({n['type']})" + (f" · score: {n['centrality']:.2f}" if n["source_location"] else "") + (f"\n{n['description']}" if n["description"] else "")
        t += f"\n→ File: {n['source_file']}" + (f" {n['source_location']}" if n["source_location"] else "") + "\n\n"
        return -(-len(t) // 4)

    used, chosen = rt.header_cost(question, budget), []

    def add(v):
        nonlocal used
        if v not in chosen and used + cost(v) <= budget * 0.95:
            chosen.append(v)
            used += cost(v)

    ranked = sorted(scores, key=lambda v: -scores[v])
    if mode == "bfs":
        for v in ranked:
            if used >= budget * 0.9:
                break
            add(v)
            for u in near[v]:
                if u not in chosen and used < budget * 0.9 and scores.get(u, 0) >= min_score / 2:
                    add(u)
    else:
        seen = set()

        def visit(v, depth):
            if depth > 5 or used >= budget * 0.9:
                return
            seen.add(v)
            add(v)
            for u in sorted((u for u in near[v] if u not in seen), key=lambda u: -scores.get(u, 0))[:3]:
                if u not in seen:
                    visit(u, depth + 1)

        if ranked:
            visit(ranked[0], 0)
    return used, chosen


@pytest.mark.parametrize("mode", ["bfs", "dfs"])
@pytest.mark.parametrize(("question", "budget"), [("authenticate user validation", 4000), ("JWT middleware authentication", 4000), ("auth", 500), ("auth", 75), ("user user", 90), ("quantum chromodynamics meson decay", 1000)])
def test_query(six, question, budget, mode):
    n, e, adj = six
    r = rt.query(n, e, adj, question, budget, mode)
    rows = n.orderBy("ord").collect()
    used, chosen = brute_query(rows, e.orderBy("ord").collect(), question, budget, mode)
    assert (r.tokens_used, [x["id"] for x in r.nodes.orderBy("pos").collect()]) == (used, chosen)
    assert r.tokens_used <= 0.95 * budget or not chosen
    pairs = [frozenset((x["source"], x["target"])) for x in r.edges.collect()]
    assert len(pairs) == len(set(pairs)) and all(p <= set(chosen) for p in pairs)


def test_query_on_a_random_graph(spark):
    rng = random.Random(9)
    words = ["user", "Token", "auth", "parse", "Json", "cache", "graph", "node", "x"]
    nodes = [node(f"n{i}", "".join(rng.sample(words, 2)) + str(i), rng.choice(["function", "class"]), f"src/{i % 7}.ts", f"L{i}" if i % 3 else None, " ".join(rng.sample(words, 3)) * rng.randrange(3) or None, None, 0.1) for i in range(60)]
    edges = [edge(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(150)]
    n, e = make(spark, nodes, edges)
    rows, links = n.orderBy("ord").collect(), e.orderBy("ord").collect()
    adj = gb.adjacency(e).persist()
    for question, budget in (("parse user auth token", 4000), ("parse user auth token", 300), ("graph node cache", 120)):
        r = rt.query(n, e, adj, question, budget)
        assert (r.tokens_used, [x["id"] for x in r.nodes.orderBy("pos").collect()]) == brute_query(rows, links, question, budget, "bfs")


def test_pack_continues_beyond_the_first_rows(spark):
    rows = [(f"v{i}", i, 60 if i < 40 else 1) for i in range(80)]
    seq = spark.createDataFrame([(v, (float(i), i, 0, 0)) for v, i, _ in rows], "id string, place struct<k1:double,k2:long,k3:int,k4:long>")
    costs = spark.createDataFrame([(v, c) for v, _, c in rows], "id string, cost int")
    assert rt.pack(seq, costs, 0, 100, first=4) == rt.pack(seq, costs, 0, 100) == (90, ["v0", *(f"v{i}" for i in range(40, 70))])


def test_empty_graph(six):
    n, e, adj = six
    r = rt.query(n.limit(0), e.limit(0), adj.limit(0), "x")
    assert r.nodes.count() == 0 and r.tokens_used == 0 and r.summary().first()["coverage"] == 0


def test_format_and_explain(six):
    n, e, adj = six
    text = rt.format_result(rt.query(n, e, adj, "authenticate user middleware"))
    assert "### Classs" in text and "authenticateUser" in text and "- JWTMiddleware → **calls** → authenticateUser _[inferred]_" in text
    assert "src/middleware.ts (file)" not in text
    about = rt.explain(n, e, adj, "AUTHENTICATEuser")
    assert about.startswith("## authenticateUser (function)") and "#### calls (4)" in about and "- ← **src/auth.ts** (file) _EXTRACTED_" in about
    assert "No entity" in rt.explain(n, e, adj, "100%")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_held_and_edges_not_sorted(spark):
    """Joins of edges with many nodes: neither a sort of all edges nor a broadcast of all ids."""
    nodes = spark.range(100_000).select(F.col("id").alias("ord"), F.concat(F.lit("v"), "id").alias("id"))
    edges = spark.range(1000).select(F.col("id").alias("ord"), F.concat(F.lit("v"), "id").alias("source"), F.concat(F.lit("v"), F.col("id") + 99_500).alias("target"), F.lit("calls").alias("relation"))
    kept = gb.drop_dangling(edges, nodes)
    assert kept.count() == 500 and "ShuffledHashJoin" in _plan(kept) and "SortMergeJoin" not in _plan(kept) and "BroadcastHashJoin" not in _plan(kept)
    few = gb.induced(edges, nodes.limit(3))
    assert "BroadcastHashJoin" in _plan(few)  # a small choice is broadcast
    merged = gb.merge(nodes.limit(0), kept, nodes, edges, dedup_edges=True)[1]
    assert merged.count() == 500
    assert "SortMergeJoin" not in _plan(an.degrees(nodes, gb.adjacency(edges)))


@pytest.mark.parametrize("budget", [60, 150, 400, 5000])
def test_best_nodes_first_equals_all(spark, budget):
    """The sequence is made of the best nodes first; with ever more of them the result is that of the whole sequence."""
    rnd = random.Random(budget)
    ranked = spark.createDataFrame([(i, f"v{i}", rnd.choice([0.2, 0.4, 0.4, 0.9])) for i in range(90)], "ord long, id string, score double")
    pairs = sorted({(rnd.randrange(100), rnd.randrange(100)) for _ in range(300)})
    adj = gb.adjacency(spark.createDataFrame([(k, f"v{a}", f"v{b}") for k, (a, b) in enumerate(pairs)], "ord long, source string, target string"))
    costs = spark.createDataFrame([(f"v{i}", rnd.randrange(1, 30)) for i in range(100)], "id string, cost int")
    whole = rt.pack(rt.candidate_sequence(ranked, adj, 0.15), costs, 20, budget)
    assert rt._bfs(ranked, adj, costs, 20, budget, 0.15, first=2) == rt._bfs(ranked, adj, costs, 20, budget, 0.15) == whole and whole[1]
