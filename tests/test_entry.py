"""The entry point: its three functions, and that all but the corpus operators live without their folders."""

import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40


def test_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse", ".tmp"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') or x == 'pipeline' for x in q); assert set(e.oracle_sql()) <= set(q); print('ok')"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert done.stdout.strip() == "ok", done.stderr
    # and the tests that are left pass: here those of text, and all are collected
    run = lambda *a: subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider", *a], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    collected = run("tests", "--collect-only")
    assert collected.returncode == 0 and "llm" not in collected.stdout, collected.stdout[-2000:]
    passed = run("tests/test_text.py")
    assert passed.returncode == 0, passed.stdout[-2000:]


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(ROOT, "graphloom")):
        if f"{os.sep}llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        text = f.read()
                    assert not re.search(r"\bllm\b", text), name


@needs_data
def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["id", "label", "degree"] and got.count() == 10


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr(tuple(plain(r[columns.index(c)]) for c in sorted(columns))) for r in found.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(columns))) for r in df.collect()) == want
    spark.catalog.clearCache()


@needs_data
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0
    spark.catalog.clearCache()


@needs_data
def test_communities_of_the_whole_star_graph(spark):
    """Every table's rows and edges, against a plain loop over the files."""
    read = lambda sql: duckdb.sql(sql.replace("@", DATA)).fetchall()
    kinds = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
    near = {f"{kind}_{k}": {} for kind, key in kinds.items() for (k,) in read(f"select {key} from '@/{kind}.parquet' order by 1")}
    owned = [("nation", "region", "n_nationkey, n_regionkey"), ("customer", "nation", "c_custkey, c_nationkey"), ("supplier", "nation", "s_suppkey, s_nationkey")]
    edges = [(f"{owner}_{o}", f"{kind}_{k}") for kind, owner, columns in owned for k, o in read(f"select {columns} from '@/{kind}.parquet' order by 1")]
    edges += [(f"supplier_{s}", f"part_{p}") for s, p in read("select distinct l_suppkey, l_partkey from '@/lineitem.parquet' order by 1, 2")]
    for a, b in edges:
        near[a].setdefault(b)
        near[b].setdefault(a)
    label = {v: i for i, v in enumerate(near)}
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
    assert {r["id"]: r["community"] for r in entry.queries()["communities"](spark, DATA).collect()} == label
