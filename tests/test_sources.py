"""Extraction, the versioned store, the streaming fold, git history, payloads and curation."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import curate, graph
from loamgraph.schema import EDGES_DDL, NODES_DDL
from loamgraph.sources import extract, history
from loamgraph.sources.store import Store
from loamgraph.streaming import fold

JAVA = "package a.b;\nimport a.c.Svc;\npublic class Ctrl extends Base {\n  private Svc svc;\n  public void run(String x, int n) {\n    svc.find(x);\n    helper();\n  }\n  void helper() { String s = \"}\"; }\n  static class Inner { void deep() {} }\n}\n"
SVC = "package a.c;\npublic interface Svc { Object find(String q); }\n"
OTHER = "package a.d;\npublic class Other { void find(String q) {} void helper() {} }\n"
FILES = [
    ("r/src/main/java/a/b/Ctrl.java", JAVA),
    ("r/src/main/java/a/c/Svc.java", SVC),
    ("r/src/main/java/a/d/Other.java", OTHER),
    ("r/app.py", "import os\nLIMIT = 3\n\n\nclass A(B):\n    def f(self, x):\n        return self.g(x)\n\n    def g(self, *r):\n        pass\n\n\ndef top(a):\n    A().f(a)\n"),
    ("r/go/x.go", 'package x\n\nimport "fmt"\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) Do(s string) string {\n\treturn help(s)\n}\n\nfunc help(s string) string {\n\treturn s\n}\n'),
    ("r/src/m.rs", "pub struct S {}\nimpl S {\n    pub fn f(&self, x: u8) -> u8 { g(x) }\n}\nfn g(x: u8) -> u8 { x }\n"),
    ("r/web/a.ts", "import { b } from './b';\nexport class W {\n  go(x: string): void { b(x); }\n}\nexport const h = (y: number) => { return y; };\n"),
    ("r/web/b.ts", "export function b(x: string) { return x; }\n"),
    ("r/K.kt", "package k\n\nimport k.z.Q\n\nclass K(val q: Q) {\n    fun f(x: Int): Int {\n        return g(x)\n    }\n    fun g(x: Int): Int = x\n}\n"),
    ("r/broken.java", "class X {"),
    ("r/notes.txt", "x"),
    ("r/null.py", None),
]


def test_extraction(spark):
    files = spark.createDataFrame([("r", "c1", p, t) for p, t in FILES], "repo string, source_commit string, path string, content string")
    f = extract.facts(files).cache()
    nodes = {(r["kind"], r["qualified_name"]): r for r in extract.extracted_nodes(f).collect()}
    for k in [("Package", "a.b"), ("Class", "a.b.Ctrl"), ("Class", "a.b.Ctrl.Inner"), ("Method", "a.b.Ctrl#run(String,int)"), ("Method", "a.b.Ctrl.Inner#deep()"), ("Method", "A#f(self,x)"), ("Function", "top(a)"), ("Variable", "LIMIT"), ("Class", "r/go.T"), ("Method", "r/go.T#Do(string)"), ("Function", "r/go.help(string)"), ("Class", "r::m::S"), ("Method", "r::m::S#f(u8)"), ("Class", "r/web/a.ts.W"), ("Method", "r/web/a.ts.W#go(string)"), ("Function", "r/web/a.ts.h(number)"), ("Function", "r/web/b.ts.b(string)"), ("Class", "k.K"), ("Method", "k.K#f(Int)"), ("File", "r/broken.java")]:
        assert k in nodes, k
    assert nodes["Method", "a.b.Ctrl#run(String,int)"]["start_line"] == 5 and nodes["Method", "a.b.Ctrl#run(String,int)"]["end_line"] == 8
    assert not any("broken" in q and k != "File" for k, q in nodes)
    e = {(r["kind"], r["src"], r["dst"]): r["resolution"] for r in extract.extracted_edges(f).collect()}
    assert e["CALLS", "a.b.Ctrl#run(String,int)", "a.c.Svc#find(String)"] == "typed"
    assert ("CALLS", "a.b.Ctrl#run(String,int)", "a.d.Other#find(String)") not in e
    assert e["CALLS", "a.b.Ctrl#run(String,int)", "a.b.Ctrl#helper()"] == "typed"
    assert e["DEPENDS_ON", "a.b.Ctrl", "a.c.Svc"] == "name" and ("IMPORTS", "r/src/main/java/a/b/Ctrl.java", "a.c.Svc") in e
    assert ("CALLS", "A#f(self,x)", "A#g(self,*r)") in e and ("CALLS", "r/go.T#Do(string)", "r/go.help(string)") in e and ("CALLS", "r::m::S#f(u8)", "r::m.g(u8)") in e or ("CALLS", "r::m::S#f(u8)", "r::m::g(u8)") in e
    assert ("IMPORTS", "r/web/a.ts", "r/web/b.ts") in e and ("CALLS", "r/web/a.ts.W#go(string)", "r/web/b.ts.b(string)") in e
    assert ("CALLS", "k.K#f(Int)", "k.K#g(Int)") in e and ("CONTAINS", "a.b.Ctrl", "a.b.Ctrl.Inner") in e
    assert extract.extracted_edges(extract.facts(files.limit(0))).count() == 0


def sighting(i, at, path):
    return ("File", i, i, i, None, path, 1, 2, None, None, None, None, at, "who", at, at, None)


def test_store_and_stream(spark, tmp_path):
    s = Store(spark, str(tmp_path / "g"))
    assert s.read("nodes") is None
    first = spark.createDataFrame([sighting("f", "2024-01-01T00:00:00Z", "a"), sighting("g", "2024-01-01T00:00:00Z", "a")], NODES_DDL)
    v = s.upsert("nodes", first)
    assert s.version("nodes") == v
    s.upsert("nodes", first)
    assert s.read("nodes").count() == 2
    late = spark.createDataFrame([sighting("f", "2023-01-01T00:00:00Z", "older"), sighting("g", "2024-02-01T00:00:00Z", "newer")], NODES_DDL)
    late.write.parquet(str(tmp_path / "in"))
    q = fold.fold_stream(spark, str(tmp_path / "in"), "nodes", s, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r["id"]: r["path"] for r in s.read("nodes").collect()} == {"f": "a", "g": "newer"}
    s.write("edges", graph.edges_now(spark.createDataFrame([], EDGES_DDL)))
    s.wipe_plane("main")
    assert s.read("nodes").count() == 2
    w = {(str(r["window_start"])[:10], r["n"]) for r in fold.windowed_activity(first.union(late)).collect()}
    assert w == {("2024-01-01", 2), ("2023-01-01", 1), ("2024-02-01", 1)}


def git(repo, *a):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)


def test_history(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git(repo, "init", "-b", "main")
    (repo / "a.py").write_text("def f():\n    pass\n")
    (repo / "b.py").write_text("x = 1\n")
    git(repo, "add", "-A")
    git(repo, "commit", "-m", "one")
    (repo / "a.py").write_text("def f():\n    pass\n\n\ndef g():\n    f()\n")
    (repo / "b.py").unlink()
    (repo / "node_modules").mkdir()
    (repo / "node_modules" / "z.js").write_text("x")
    git(repo, "add", "-A")
    git(repo, "commit", "-m", "two")
    git(repo, "branch", "side", "HEAD~1")
    log = history.commits(spark, str(repo)).cache()
    assert [r["commit_ord"] for r in log.orderBy("commit_ord").collect()] == [0, 1]
    shas = [r["source_commit"] for r in log.orderBy("commit_ord").collect()]
    ch = {tuple(r) for r in history.changed_paths(log, str(repo)).collect()}
    assert ch == {(shas[0], "A", "a.py"), (shas[0], "A", "b.py"), (shas[1], "M", "a.py"), (shas[1], "D", "b.py"), (shas[1], "A", "node_modules/z.js")}
    tr = history.trees(log, str(repo)).withColumn("repo", F.lit("r"))
    assert {(r["source_commit"], r["path"]) for r in tr.collect()} == {(shas[0], "a.py"), (shas[0], "b.py"), (shas[1], "a.py")}
    names = {(r["source_commit"], r["qualified_name"]) for r in extract.extracted_nodes(extract.facts(tr)).where("kind='Function'").collect()}
    assert names == {(shas[0], "f()"), (shas[1], "f()"), (shas[1], "g()")}
    m = history.modifies(history.changed_paths(log, str(repo)), log, "r")
    assert "author" not in m.columns and m.count() == 4
    assert history.membership(spark, str(repo), ["side", "main", "side"]).count() == 3
    for bad in ("nope", "--all", ""):
        with pytest.raises(ValueError):
            history.check_branches(str(repo), [bad])
    subprocess.run(["git", "clone", "--depth", "1", f"file://{repo}", str(tmp_path / "shallow")], check=True, capture_output=True)
    with pytest.raises(RuntimeError):
        history.check_branches(str(tmp_path / "shallow"), ["main"])


def test_payload_files(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps([{"title": "a", "decides": ["x"]}, {"title": "b", "decides": None}]))
    (tmp_path / "2.json").write_text(json.dumps([{"title": "c", "decides": []}]))
    rows = history.payloads(spark, str(tmp_path), "title string, decides array<string>").orderBy("seq").collect()
    assert [r["title"] for r in rows] == ["a", "b", "c"]


REQUEST = {"target_id": "T", "allowed_refs": ["A", "B"], "generator": "g", "model": "m", "source_commit": "c"}
ANSWER = {"claims": [{"text": "it loads rows", "source_refs": ["A", "Z"]}, {"text": "unfounded", "source_refs": ["Z"]}], "gap": "callers unknown", "confidence": 0.5}


def test_curation():
    out = curate.produce(REQUEST, lambda p: json.dumps(ANSWER) if "- A" in p else "")
    assert out["claims"] == [{"text": "it loads rows", "source_refs": ["A"]}] and out["confidence"] == 0.5
    for bad in ({"gap": " "}, {"confidence": True}, {"confidence": 2}, {"claims": []}, {"claims": [{"text": "this part should be split", "source_refs": ["A"]}]}):
        with pytest.raises(curate.Refused):
            curate.produce(REQUEST, lambda p, bad=bad: json.dumps({**ANSWER, **bad}))
    with pytest.raises(curate.Refused):
        curate.produce({**REQUEST, "judge": "g"}, lambda p: json.dumps(ANSWER))
    with pytest.raises(curate.Refused):
        curate.produce(REQUEST, lambda p: "no json")
