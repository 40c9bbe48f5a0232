"""Listing, extraction, cache, persistence, the build of a small project, and the stream."""

import os

import pytest

from graphloom.extract.run import candidates, extract_project, extract_source
from graphloom.operators.build import adjacency
from graphloom.plans.project import Project
from graphloom.schema import EDGES, NODES
from graphloom.sources.files import by_extension, list_files
from graphloom.sources.graph_io import read_graph, read_json, write_graph, write_json
from graphloom.streaming.incremental import landing, upsert_stream

FILES = {
    "src/auth.ts": "export function login(u: string): boolean {\n  return check(u) && verify(u);\n}\n/** Checks\n * a user. */\nfunction check(u: string) {\n  return !!u;\n}\n\nfunction verify(u: string) { return true; }\nconst skipped = () => 1;\n",
    "src/controller.ts": "import { login } from './auth';\nimport x from '../up';\nexport class Controller extends Base<T> implements I {\n  private n = 1;\n  run(u: string) {\n    if (u) { return login(u); }\n    return false;\n  }\n}\ninterface Shape { a: number }\ntype Alias = string;\n",
    "pkg/__init__.py": "import os as o\n",
    "pkg/_private.py": "@cached\ndef deco(): pass\n\nclass A(Base, metaclass=M):\n    def method(self): helper()\n\ndef f(x):\n    '''Doc\n    string.'''\n    return g(h(x)).y()\n\ndef g(x): pass\n",
    "run.sh": "function setup() {\n :\n}\n  indented() {\n}\nmain () { setup; }\n",
    "conf.json": '{"file": 1, "b": 1, "10": 1, "2": 2, "b": 3}',
    "list.json": "[1, 2]",
    "bad.json": "{",
    "many.json": "{" + ", ".join(f'"k{i}": {i}' for i in range(30)) + "}",
    "main.go": 'package main\n\nimport (\n\tf "fmt"\n\t"os"\n)\n\ntype Point struct {\n\tX int\n}\ntype Name string\n\nfunc (p *Point) Move() { step() }\n\nfunc step() { f.Println("func no() {}") }\n',
    "App.java": "import a.b.C;\n\npublic class App extends Base implements Run {\n  // class No {}\n  public App(int x) { init(x); }\n  void go() { util.run(); init(1); }\n}\n",
    "lib.rs": "use std::io;\n\npub struct S { x: i32 }\ntrait T: Clone { fn no(&self); }\nfn free() { call() }\nenum E { A }\n",
    "node_modules/x.js": "function no() {}",
    ".hidden.py": "def no(): pass",
    "notes.md": "# no",
    "big.py": "x = 1\n" * 200_000,
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("project")
    for name, text in FILES.items():
        os.makedirs(os.path.dirname(base / name), exist_ok=True)
        (base / name).write_text(text)
    return str(base)


def test_listing(spark, root):
    got = [r["path"] for r in list_files(spark, root).orderBy("ord").collect()]
    assert got == sorted(set(FILES) - {"node_modules/x.js", ".hidden.py", "notes.md"})
    assert {r["ext"]: r["n"] for r in by_extension(list_files(spark, root)).collect()}[".json"] == 4
    assert list_files(spark, root, max_files=3).count() == 3
    with pytest.raises(FileNotFoundError):
        list_files(spark, root + "/absent")


def facts(name, complete=False):
    f = extract_source(name, FILES[name], set(FILES), complete)
    return {(n[1], n[2], n[3]) for n in f.nodes if n[2] != "file"}, [(e[0], e[1], e[2]) for e in f.edges], f


def test_typescript():
    nodes, edges, f = facts("src/auth.ts")
    assert nodes == {("login", "function", "L1"), ("check", "function", "L6"), ("verify", "function", "L10")}
    assert [e[1] for e in edges if e[2] == "calls"] == ["src_auth_check", "src_auth_verify"]
    assert next(n[4] for n in f.nodes if n[1] == "check") == "Checks a user."
    nodes, edges, _ = facts("src/controller.ts")
    assert nodes == {("Controller", "class", "L3"), ("Controller.n", "method", "L4"), ("Controller.run", "method", "L5"), ("Shape", "interface", "L10"), ("Alias", "type", "L11")}
    assert ("src_controller_file", "src_auth_file", "imports") in edges and sum(e[2] == "imports" for e in edges) == 1
    assert ("src_controller_Controller", "src_controller_Base", "inherits") in edges
    assert not any(e[2] == "calls" for e in edges)
    more = facts("src/controller.ts", True)[1]
    assert ("src_controller_file", "src_auth_login", "imports") in more and ("src_controller_file", "src_auth_login", "imports") not in edges


def test_python():
    nodes, edges, f = facts("pkg/_private.py")
    assert nodes == {("deco", "function", "L1"), ("A", "class", "L4"), ("f", "function", "L7"), ("g", "function", "L12")}
    assert [e[1] for e in edges if e[2] == "calls"] == ["pkg__private_g_h_x___y", "pkg__private_g", "pkg__private_h"]
    assert [e[1] for e in edges if e[2] == "inherits"] == ["pkg__private_Base", "pkg__private_metaclass", "pkg__private_M"]
    assert next(n[4] for n in f.nodes if n[1] == "f") == "Doc string."
    assert ("A.method", "method", "L5") in facts("pkg/_private.py", True)[0]
    assert facts("pkg/__init__.py")[1] == [("pkg___init___file", "pkg___init___os_as_o", "imports")]


def test_shell_json_go():
    assert facts("run.sh")[0] == {("setup", "function", "L1"), ("main", "function", "L6")}
    assert [n[1] for n in facts("conf.json")[2].nodes[1:]] == ["2", "10", "file", "b"]
    assert facts("list.json")[0] == facts("bad.json")[0] == set()
    assert len(facts("many.json")[0]) == 20
    nodes, edges, _ = facts("main.go")
    assert nodes == {("Point", "struct", "L8"), ("Name", "type", "L11"), ("Point.Move", "method", "L13"), ("step", "function", "L15")}
    assert [e[1] for e in edges if e[2] != "contains"] == ["main_f", "main_f_Println"]


def test_generic():
    nodes, edges, _ = facts("App.java")
    assert nodes == {("App", "class", "L3"), ("go", "function", "L6")}
    assert {e[1] for e in edges if e[2] == "calls"} == {"App_init", "App_util"}
    assert {e[1] for e in edges if e[2] == "inherits"} == {"App_Base", "App_Run"}
    assert facts("lib.rs")[0] == {("S", "struct", "L3"), ("T", "trait", "L4"), ("E", "enum", "L6")}
    assert ("free", "function", "L5") in facts("lib.rs", True)[0]


def test_module_candidates():
    assert candidates("src/a.ts", "./b")[:2] == ["src/b.ts", "src/b.tsx"] and "src/b/index.ts" in candidates("src/a.ts", "./b")
    assert candidates("src/a.ts", "./x.js")[0] == "src/x.js"
    assert ".." in candidates("src/a.ts", "../b")[0] and candidates("src/a.ts", "../b", True)[0] == "b.ts"


def test_project(spark, root):
    p = Project(spark, root)
    assert p.query("x").is_error and p.explain("x").is_error and p.map() == "" and p.stale() == (False, 0)
    built = p.build()
    assert not built.is_error and built.details["cached"] == 0 and built.details["files"] == 13
    assert p.build().details == {"skipped": True}
    nodes, edges, adj = p.load()
    ids = [r["id"] for r in nodes.collect()]
    assert len(ids) == len(set(ids)) and all(0 <= r["centrality"] <= 1 and r["community"] is not None for r in nodes.collect())
    ends = {r["id"] for r in nodes.select("id").collect()}
    assert all(e["source"] in ends and e["target"] in ends for e in edges.collect())
    assert not any(r["source_file"] == "big.py" for r in nodes.collect())
    assert "login" in p.query("login user").text and "## login (function)" in p.explain("LOGIN").text
    assert os.path.exists(f"{p.out}/GRAPH_REPORT.md") and os.path.exists(f"{p.out}/graph.html") and "src/auth.ts" in p.map()
    assert p.status().startswith(f"{len(ids)} nodes")
    n = edges.count()
    again = p.build(update=True)
    assert again.details["cached"] == 12 and again.details["extracted"] == 0 and again.details["edges"] == 2 * n
    assert p.build(update=True, dedup_edges=True).details["edges"] == 2 * n
    with open(os.path.join(root, "run.sh"), "a") as f:
        f.write("later () { :; }\n")
    os.utime(os.path.join(root, "run.sh"), (4e9, 4e9))
    assert p.stale() == (True, 1)
    changed = p.build(force=False, update=True)
    assert changed.details["extracted"] == 1 and p.load()[0].where("id = 'run_later'").count() == 1
    assert p.build(force=True, no_viz=True, no_report=True).details["edges"] == n + 1


def test_no_files(spark, tmp_path):
    assert "No code files" in Project(spark, str(tmp_path)).build().text
    assert Project(spark, str(tmp_path / "absent")).build().is_error


def test_json_round_trip(spark, root, tmp_path):
    _, nodes, edges, _ = extract_project(spark, root)
    write_json(nodes, edges, str(tmp_path / "graph.json"))
    n, e = read_json(spark, str(tmp_path / "graph.json"))
    drop = lambda df: sorted(map(str, df.drop("ord").collect()))
    assert drop(n) == drop(nodes) and drop(e) == drop(edges)
    assert [r["id"] for r in n.orderBy("ord").collect()] == [r["id"] for r in nodes.orderBy("ord").collect()]


def test_versions_keep_readers(spark, tmp_path):
    nodes = spark.createDataFrame([(0, "a", "a", "file", "a", None, None, None, None)], NODES)
    edges = spark.createDataFrame([], EDGES)
    path = f"file://{tmp_path}/graph"
    write_graph(nodes, edges, path)
    old = read_graph(spark, path)[0]
    write_graph(nodes.union(nodes), edges, path)
    assert old.count() == 1 and read_graph(spark, path)[0].count() == 2


def test_stream(spark, tmp_path):
    node = lambda i: (i, f"v{i}", f"v{i}", "function", "x", None, None, None, None)
    edge = lambda i, a, b: (i, f"v{a}", f"v{b}", "calls", "INFERRED", 0.85)
    graph, folder, checkpoint = (f"file://{tmp_path}/{x}" for x in ("graph", "landing", "checkpoint"))
    for nodes, edges in (([0, 1], [(0, 0, 1), (1, 0, 9)]), ([1, 2], [(0, 1, 2), (1, 0, 1)])):
        landing(spark.createDataFrame([node(i) for i in nodes], NODES), spark.createDataFrame([edge(*x) for x in edges], EDGES)).write.mode("append").parquet(folder)
        upsert_stream(spark, folder, graph, checkpoint).awaitTermination()
    n, e = read_graph(spark, graph)
    assert sorted(r["id"] for r in n.collect()) == ["v0", "v1", "v2"]
    assert sorted((r["source"], r["target"]) for r in e.collect()) == [("v0", "v1"), ("v1", "v2")]
    assert adjacency(e).count() == 4
